"""Operators for training-data pipelines over columns of documents.

Nothing outside this folder imports it.  `queries.py` names one query per
operator; the top-level entry module adds them when this package is present.
"""
