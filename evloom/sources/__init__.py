"""evloom.sources"""
