"""Readers and writers of feature tables."""
