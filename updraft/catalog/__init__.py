"""Named queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

import importlib

from updraft.catalog.registry import ORACLES, QUERIES

FAMILIES = ("tracks", "spatial", "grids", "heat", "terrain", "beacons", "health", "streams", "scores")


def load() -> tuple[dict, dict]:
    """All registered queries and oracles."""
    for family in FAMILIES:
        importlib.import_module(f"updraft.catalog.{family}")
    return QUERIES, ORACLES
