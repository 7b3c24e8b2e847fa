"""Structured Streaming: ingest, admission by token bucket, the engine's own metrics."""
