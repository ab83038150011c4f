"""Scans, schema checks, sinks and atomic publication."""
