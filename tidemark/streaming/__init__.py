"""The analyses as Structured Streaming queries."""
