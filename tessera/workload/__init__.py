"""Registered queries: each runs an operator over whole driver tables."""
