"""Operators of a large-scale text-corpus pipeline, written for Spark.

Nothing outside this subpackage imports it.
"""
