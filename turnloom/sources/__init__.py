"""turnloom.sources"""
