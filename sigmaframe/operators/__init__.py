"""Operators on signals, matrices and grids held in DataFrames."""
