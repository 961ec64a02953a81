"""Sinks: the store, CSV, JSON lines, subtitles."""
