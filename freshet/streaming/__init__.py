"""Incremental images."""
