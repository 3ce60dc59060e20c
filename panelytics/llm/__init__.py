"""Operators of a training-data pipeline: removal of repeats and leaks, scans, extraction, counting and packing.

Every operator takes DataFrames and returns DataFrames and selects the columns it needs by name, so further columns
of the input never matter. ``queries`` applies each to its table with production parameters.
"""
