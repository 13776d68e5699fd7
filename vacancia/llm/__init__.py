"""Operators of a training-data pipeline: scoring, deduplication, decontamination, packing, archives, media."""
