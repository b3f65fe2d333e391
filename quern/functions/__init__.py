"""Expressions, Column -> Column."""
