"""Geometry kernels: plain Python and numpy, no Spark."""
