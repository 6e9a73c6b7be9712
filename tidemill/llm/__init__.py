"""Operators for preparing training data: sharding, decontamination, near-duplicates, nearest
neighbours, language-model scoring, packing, toxicity, token files, language identification, WARC."""
