"""Operators on change logs and sorted runs: DataFrame in, DataFrame out."""
