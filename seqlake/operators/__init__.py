"""TODO"""
