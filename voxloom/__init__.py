"""Volumetric and time-lapse object analytics on Spark DataFrames."""
