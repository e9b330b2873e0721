"""Corpus-scale analytics for timed text, written for Spark DataFrames."""
