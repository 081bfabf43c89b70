"""Training-data operators: decontamination, quality, packing, extraction, licenses, languages, secrets, near-duplicates, URLs, repeats."""
