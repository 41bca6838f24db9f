"""Sequence and assembly-graph analytics as plain Spark DataFrame programs."""
