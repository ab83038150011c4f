"""Relational and numeric operators, DataFrame to DataFrame."""
