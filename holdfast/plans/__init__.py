"""Compositions of operators: the runs that users start."""
