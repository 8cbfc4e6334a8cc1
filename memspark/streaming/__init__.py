"""Streaming views of the access log (an extension: the logs are append-only and event-timed)."""
