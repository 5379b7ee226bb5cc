"""Training-data operators: filtering, near-duplicates, tokenised output, formatting, packing."""
