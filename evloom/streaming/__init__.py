"""evloom.streaming"""
