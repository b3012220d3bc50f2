"""Structured Streaming forms, each with a batch twin."""
