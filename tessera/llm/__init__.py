"""Training-data operators: cleaning, deduplication, mixing, search and labelling of large text corpora."""
