"""Operators of a training-data pipeline: ten methods over a table of documents.

Nothing else in the library imports this subpackage.  ``queries`` registers one
query per operator; every other module holds one operator or a helper.
"""
