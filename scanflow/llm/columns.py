"""Names for helper columns that no table of the caller holds."""

from __future__ import annotations

from collections.abc import Iterable


def free(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` with as many underscores before them as make them new; Spark does not tell upper from lower case."""
    held, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out
