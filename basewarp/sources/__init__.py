"""Readers of sequences and pattern files, and sinks."""
