"""The registered catalogue of the core: queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("quality", "media", "search", "stored", "relations", "plugged")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in _MODULES:
        merged |= getattr(import_module(f"{__name__}.{name}"), attribute)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
