"""Patterns: syntax tree, parser and compilation to DataFrames."""
