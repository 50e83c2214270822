"""Compilers: patterns, rules and join specifications."""
