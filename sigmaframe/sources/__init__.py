"""Readers that shape tables into signals, matrices and grids, and writers."""
