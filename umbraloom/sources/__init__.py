"""Readers and writers. Files are read through Spark's own reader, so any store that Spark knows will do; formats are decoded on executors."""
