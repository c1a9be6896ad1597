"""Training-data operators: one module for each, all over (id, text) DataFrames.

Nothing outside this folder imports it.
"""
