"""Training-data operators: mixing, token files, dedup, extraction, BPE, n-gram scoring, quality, toxicity,
near-duplicates, secrets, line dedup, embedding whitening and phrases. Nothing outside this subpackage imports it."""
