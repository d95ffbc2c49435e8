"""Byte-level column functions: hashes, codecs, compact-disc codes."""
