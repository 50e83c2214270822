"""Basewarp: nucleic-acid pattern analytics as Spark DataFrames."""
