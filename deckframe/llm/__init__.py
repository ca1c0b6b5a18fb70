"""Operators of a training-data pipeline: dedup, filters, decontamination, mixing."""
