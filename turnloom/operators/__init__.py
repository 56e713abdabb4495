"""turnloom.operators"""
