"""Operators for training-data pipelines over text, pages and vectors.

Nothing outside this folder imports it.
"""
