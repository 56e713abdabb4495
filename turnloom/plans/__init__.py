"""turnloom.plans"""
