"""Versioned, content-addressed file trees as Spark DataFrames."""
