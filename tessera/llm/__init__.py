"""Training-data operators: cleaning, filtering, deduplication and tokens of web text."""
