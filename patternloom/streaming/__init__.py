"""Feeding unbounded rows to the fixpoint."""
