"""Streams of query events: logs as they are written, errors paired with their statements, traffic by windows, and what follows a scan."""
