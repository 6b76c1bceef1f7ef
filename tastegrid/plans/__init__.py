"""Compositions of operators: split, evaluation, grid and jobs."""
