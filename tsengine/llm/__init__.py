"""Operators of a training-data pipeline: filtering, near duplicates, scoring, archives, mixing, packing."""
