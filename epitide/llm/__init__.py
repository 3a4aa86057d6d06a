"""Operators of a training-data pipeline: dedup, quality, toxicity, personal data, language, decontamination, mixing, sharding."""
