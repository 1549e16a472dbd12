"""Operators on DataFrames: segmentation, pattern joins, fixpoints, evaluation."""
