"""Whole plans: the indexer, and the registered queries."""
