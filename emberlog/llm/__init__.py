"""Operators of a training-data pipeline: fingerprints, duplicates, quality, tokens, packing, toxicity, chat."""
