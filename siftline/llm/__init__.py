"""Training-data operators: scoring, scanning, deduplication, formatting and mixing."""
