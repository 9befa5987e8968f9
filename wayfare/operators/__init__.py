"""DataFrame operators: curation, near-duplicates, TF-IDF, search, fusion, context."""
