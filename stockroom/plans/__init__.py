"""stockroom.plans"""
