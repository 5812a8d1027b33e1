"""Operators for large text corpora: archives, vectors, classifiers, tokenizers, deduplication and mixing.

Nothing else in the package imports this subpackage; it can be deleted as a whole.
"""
