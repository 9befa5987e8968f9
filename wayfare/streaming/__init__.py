"""Structured Streaming forms of ingest and conversation history."""
