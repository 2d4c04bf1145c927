"""Operators on tables of readings."""
