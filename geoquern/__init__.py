"""Geospatial analytics on PySpark: ``ST_`` functions, spatial joins, tiles and routing."""
