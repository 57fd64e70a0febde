"""Continuous change ingestion."""
