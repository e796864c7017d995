"""Millrace: data wrangling, statistics and mining operators over Spark DataFrames."""
