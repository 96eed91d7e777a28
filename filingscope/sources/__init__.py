"""Readers and writers: filing indexes, landed filings, typed tables."""
