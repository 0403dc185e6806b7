"""Samples as streams."""
