"""Structured Streaming counterparts of the event-driven operators."""
