"""stockroom.operators"""
