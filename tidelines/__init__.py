"""Wildcard-aware analytics on attribute histories, and operators for large text corpora, as Spark plans."""
