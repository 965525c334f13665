"""Structured Streaming: idempotent application of change batches, and stateful filters."""
