"""Training-data operators: filtering, deduplication, mixing, formatting and tokenisation of document corpora."""
