"""All registered queries of the ledger and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("ledger", "files", "search", "text")


def _all() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"{__package__}.{name}").Q
    return out


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
