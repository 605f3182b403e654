"""Operators for large text corpora, built on Spark DataFrames.

Nothing else in the library imports this subpackage.  Each operator keeps its
own general interface; ``llm.queries`` derives the registered queries from them.
"""
