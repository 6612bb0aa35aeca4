"""evloom.functions"""
