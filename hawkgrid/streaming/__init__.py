"""Structured Streaming forms of the stateful operators, sources and sinks."""
