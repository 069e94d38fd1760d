"""Training-data operators: ten stages of a text pipeline over DataFrames.

Nothing outside this subpackage imports it.
"""
