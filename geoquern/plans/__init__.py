"""Rewrites of spatial predicates into plans that Spark can push down."""
