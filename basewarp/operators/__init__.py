"""Operators over sequences, hits and sites."""
