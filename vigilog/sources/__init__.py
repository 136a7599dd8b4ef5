"""Readers, per-source parsers and writers."""
