"""Operators of a training-data pipeline: identification, rules, extraction, scoring, deduplication, tokenising."""
