"""Streaming forms: queues, smoothing, interval assignment, gated updates and map upserts."""
