"""Corpus operators for training data: plain functions from DataFrames to DataFrames.

Nothing else in the library imports this subpackage.
"""
