"""Training-data operators: mixing, deduplication, scoring, search and scans over a corpus of documents."""
