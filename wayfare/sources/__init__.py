"""Readers, sinks and the versioned point table."""
