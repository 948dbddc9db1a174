"""Operators of a training-data pipeline (packing, deduplication, tokenizing ...).

Nothing else in the library imports this subpackage.  ``registry`` lists its
queries and their SQL; each other module holds one operator.
"""
