"""Readers for delimited files, JSON manifests, raw bytes and Markdown corpora."""
