"""Every registered query, by area, with its independent SQL statement."""

from __future__ import annotations

from importlib import import_module

AREAS = ["extraction", "processing", "intake", "text", "reports", "export", "evaluation", "streams"]


def _all(kind: str) -> dict:
    out: dict = {}
    for area in AREAS:
        for key, value in getattr(import_module(f"{__name__}.{area}"), kind).items():
            assert key not in out, key
            out[key] = value
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
