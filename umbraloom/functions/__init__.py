"""Scalar functions of columns: geometry, radiometry, metadata, labels. All stay inside Catalyst expressions."""
