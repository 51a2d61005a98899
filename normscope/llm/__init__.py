"""Training-data operators: tokenising, extraction, search, de-duplication, filtering, mixing.

Every operator is a function from DataFrames to DataFrames.  Nothing outside
this subpackage imports it.
"""
