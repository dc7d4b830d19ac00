"""Operators over reads: DataFrame -> DataFrame."""
