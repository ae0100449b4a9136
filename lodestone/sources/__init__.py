"""Readers and writers: source trees, JSON lines, index tables."""
