"""Operators, DataFrame -> DataFrame."""
