"""Scans, sinks and the rasters derived from tables."""
