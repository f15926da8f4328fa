"""Operators of a training-data pipeline: dedup, decontamination, scoring, mixing and sharding of documents."""
