"""Sparse settings: only what differs from the defaults is stored, and superseded defaults are let go."""

from __future__ import annotations

from typing import Any


def sparse(config: dict[str, Any], defaults: dict[str, Any]) -> dict[str, Any]:
    """The fields of config that are not the defaults; nested tables in the same way."""
    out = {}
    for key, value in config.items():
        base = defaults.get(key)
        if isinstance(value, dict) and isinstance(base, dict):
            if inner := sparse(value, base):
                out[key] = inner
        elif key not in defaults or value != base:
            out[key] = value
    return out


def full(stored: dict[str, Any], defaults: dict[str, Any]) -> dict[str, Any]:
    """The defaults with what is stored; stored fields that no default knows are dropped."""
    return {k: full(stored.get(k) or {}, v) if isinstance(v, dict) else stored.get(k, v) for k, v in defaults.items()}


def reconciled(stored: dict[str, Any], superseded: dict[str, list]) -> dict[str, Any]:
    """stored without fields (dotted names) that hold a value that once was the default."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in stored.items()}
    for name, olds in superseded.items():
        *path, last = name.split(".")
        at = out
        for p in path:
            at = at.get(p) if isinstance(at, dict) else None
        if isinstance(at, dict) and at.get(last) in olds:
            del at[last]
    return {k: v for k, v in out.items() if v != {}}
