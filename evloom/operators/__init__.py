"""evloom.operators"""
