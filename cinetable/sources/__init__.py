"""Readers: transcripts, detections, stores, and fault-separating record parsers."""
