"""Astronomical frame analytics on PySpark: frames are DataFrames of pixels keyed by frame."""
