"""Incremental ingest: fingerprint-gated batches, and streams of immutable drops."""
