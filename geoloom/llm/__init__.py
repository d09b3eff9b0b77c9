"""Operators for preparing large text collections, each a Spark job over DataFrames.

Nothing outside this subpackage imports it.
"""
