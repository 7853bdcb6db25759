"""Stateful job processing with Structured Streaming and its batch replay."""
