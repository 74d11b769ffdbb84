"""Footage-operations analytics as composable PySpark DataFrame functions."""
