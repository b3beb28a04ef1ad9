"""Soaring-flight and mountain-weather analytics on Spark DataFrames."""
