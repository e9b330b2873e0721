"""Operators for preparing training data: filters, classifiers, deduplication, packing, tokenizing, media and vector search.

Nothing outside this folder imports it.
"""
