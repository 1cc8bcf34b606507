"""Readers and writers for JSON lines, condition folders, markdown and shards."""
