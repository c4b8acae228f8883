"""stockroom.sources"""
