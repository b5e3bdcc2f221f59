"""All registered queries and their oracles."""

from __future__ import annotations

from collections import Counter
from importlib import import_module

FAMILIES = ("portfolio", "risk", "labels", "validation", "readiness", "metrics", "text", "sources", "models", "rawrows", "cells", "more", "evaluation", "gates", "bands")


def entries() -> list[tuple]:
    out = [e for f in FAMILIES for e in import_module(f".{f}", __package__).ENTRIES]
    repeated = [name for name, n in Counter(name for name, _, _ in out).items() if n > 1]
    if repeated:
        raise ValueError(f"registered more than once: {repeated}")
    return out


def queries() -> dict:
    return {name: fn for name, fn, _ in entries()}


def oracles() -> dict[str, str]:
    return {name: sql for name, _, sql in entries() if sql}
