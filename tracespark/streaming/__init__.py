"""Streaming of the trace engine."""
