"""Spatial operators on DataFrames."""
