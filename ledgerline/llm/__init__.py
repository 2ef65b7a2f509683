"""Training-data operators: quality, packing, personal data, duplicates, nearest neighbours, tokens, secrets, toxicity, mixing."""
