"""turnloom.streaming"""
