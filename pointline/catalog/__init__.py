"""The registered queries and the SQL that they are compared with."""

from __future__ import annotations

from importlib import import_module

PARTS = ("core", "evaluate", "quality", "serve", "ingest", "more", "train")


def queries() -> dict:
    return {name: f for part in PARTS for name, f in import_module(f"{__name__}.{part}").Q.items()}


def oracles() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in import_module(f"{__name__}.{part}").O.items()}
