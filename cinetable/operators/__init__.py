"""Relational and retrieval operators, each a composition of DataFrame plans."""
