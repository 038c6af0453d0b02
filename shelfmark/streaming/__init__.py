"""Structured Streaming form of the extraction flow."""
