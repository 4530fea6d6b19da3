"""Structured Streaming sources, sinks and change feeds."""
