"""Catalogue, scans, caches and sinks."""
