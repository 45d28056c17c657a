"""Logical plans that combine operators: ingestion and hybrid search."""
