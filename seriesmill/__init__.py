"""Labelled time series on PySpark: samples, expressions, rollups, rules and analytics."""
