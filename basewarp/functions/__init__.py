"""Scalar functions of sequences as Column expressions."""
