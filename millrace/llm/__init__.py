"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it. Each operator module has one
public entry point that takes and returns DataFrames; ``queries.py`` wires
the operators to the given tables.
"""
