"""stockroom.functions"""
