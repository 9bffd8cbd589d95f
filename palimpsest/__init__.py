"""Palimpsest: find, rewrite and audit sensitive text at scale with Spark DataFrames."""
