"""Operators for preparing large text corpora for training.

Nothing else in the library imports this subpackage. Each operator is a function
from DataFrames to DataFrames; ``queries`` binds them to the tables.
"""
