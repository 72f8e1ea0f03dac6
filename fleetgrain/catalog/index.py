"""All registered queries in the order of their families."""

from __future__ import annotations

from importlib import import_module

from fleetgrain.catalog.entries import Entry

FAMILIES = (
    "scalars", "metrics", "positions", "timetable", "shapes", "estimates", "swaps", "fleet", "quality", "sources", "jobs", "streams",
)


def all_entries() -> list[Entry]:
    entries: list[Entry] = []
    for family in FAMILIES:
        entries.extend(import_module(f"fleetgrain.catalog.{family}").R.entries)
    return entries
