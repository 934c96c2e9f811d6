"""Logs that keep arriving, as Structured Streaming jobs over the same operators."""
