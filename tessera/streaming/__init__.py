"""Structured Streaming jobs over a raw landing area."""
