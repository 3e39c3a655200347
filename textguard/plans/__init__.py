"""Lifecycles and registered queries."""
