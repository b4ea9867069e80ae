"""Joins, merges and folds over path tables."""
