"""evloom.plans"""
