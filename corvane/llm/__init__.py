"""Training-corpus operators: language ID, token files, LM scoring, near-duplicates, packing, BPE and fingerprints."""
