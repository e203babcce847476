"""Names of columns."""

from __future__ import annotations


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no column has it."""
    while name.lower() in (c.lower() for c in taken):
        name = "_" + name
    return name
