"""Structured Streaming form of the series continuation."""
from tallyflow.streaming.continuation import continue_stream  # noqa: F401
