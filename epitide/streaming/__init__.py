"""Incremental ingestion: new run files turned into series as they land."""
