"""Operators of a training-data pipeline: thirteen jobs over documents, pages, conversations and embeddings.

Nothing else in the library imports this package; it can be deleted as a whole.
"""
