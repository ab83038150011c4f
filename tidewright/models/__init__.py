"""Regression candidates, their search and their selection."""
