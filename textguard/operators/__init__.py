"""Operators on spans and units."""
