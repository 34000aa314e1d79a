"""Reads, edits and the node table, over parsed documents."""
