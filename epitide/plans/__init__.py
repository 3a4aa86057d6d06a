"""Compositions of operators: the analyses a user runs."""
