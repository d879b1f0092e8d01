"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; each module holds one operator and
takes and returns Spark DataFrames.
"""
