"""Screening analytics expressed as Spark plans."""
