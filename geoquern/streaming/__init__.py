"""Spatial queries on streams: the scalar functions run in them as they are."""
