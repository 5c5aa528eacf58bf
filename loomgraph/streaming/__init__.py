"""Incremental work on file streams."""
