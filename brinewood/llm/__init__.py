"""Operators of a training-data pipeline: ten operators on documents, pages and vectors.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
