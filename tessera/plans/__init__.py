"""Versioned table store, catalog and read-only query surface."""
