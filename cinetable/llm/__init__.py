"""Operators for the preparation of training data from transcripts, detections and documents.

Nothing else in the library imports this subpackage. Its registered queries and
their SQL are in ``catalogue``.
"""
