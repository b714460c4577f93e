"""Relational operators of the ensemble dataflow."""
