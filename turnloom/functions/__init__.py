"""turnloom.functions"""
