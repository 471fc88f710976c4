"""Whole plans: shadow heights of a scene, calibration of tiles, and the query catalogue."""
