"""Operators that prepare text corpora, pages and vectors for training."""
