"""Operators for building training corpora: dedup, filters, scoring, packing. Nothing outside this folder imports it."""
