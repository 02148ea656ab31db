"""Readers and parsers: files and payloads to typed rows."""
