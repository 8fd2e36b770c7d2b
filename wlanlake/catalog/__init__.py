"""Registered queries and the plain SQL each one is checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ["detections", "scalars", "frames", "datasets", "models", "streams", "files"]


def queries() -> dict:
    out = {}
    for name in MODULES:
        out.update(import_module(f"wlanlake.catalog.{name}").QUERIES)
    return out


def oracles() -> dict:
    out = {}
    for name in MODULES:
        out.update(import_module(f"wlanlake.catalog.{name}").ORACLES)
    return out
