"""Append-only logs as streams. Windows, sessions and watermarks are extensions of our own."""
