"""Helpers that shape physical plans: lineage cuts, range chunks, skew guards."""
