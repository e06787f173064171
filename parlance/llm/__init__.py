"""Operators of a training-data pipeline: scoring, de-duplication, search,
tokenizers, mixing and language models over whole document tables.

Nothing else in the library imports this package.
"""
