"""Training-data operators: decontamination, extraction, filtering, near-duplicates, token output."""
