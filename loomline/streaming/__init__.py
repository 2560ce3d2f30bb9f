"""Streaming forms of sessions, idempotent completion and rolling totals."""
