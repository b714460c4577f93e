"""Structured Streaming form of the dataflow."""
