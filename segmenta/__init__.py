"""Localization analytics as Spark DataFrames."""
