"""Names for helper columns."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(name: str, columns: Iterable[str]) -> str:
    """The name, or a longer one that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
