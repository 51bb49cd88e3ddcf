"""Audited contracting analytics expressed as Spark DataFrame plans."""
