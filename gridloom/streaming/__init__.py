"""Structured Streaming jobs: event windows, file ingest, append-only logs."""
