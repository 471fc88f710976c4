"""Relational operators over pixel, ray, footprint and tile tables."""
