"""Training-data operators: dedup, search, mixing, filtering, tokenising, scoring."""
