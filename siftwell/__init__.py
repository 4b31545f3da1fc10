"""Declarative ingestion, data quality and lineage as Spark DataFrame transformations."""
