"""Training-data operators: dedup, tokenised output, mixing, chat formatting, secret scans, scoring, packing."""
