"""Long texts in pieces, so that a task holds the words of a piece and not of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

SLICE_BYTES = 1_000_000


def slices(data: bytes, at: re.Pattern[bytes], size: int = SLICE_BYTES) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes, cut before a byte that ``at`` matches; without one the rest is one piece."""
    begin = 0
    while len(data) - begin > size:
        cut = at.search(data, begin + size)
        if cut is None:
            break
        yield data[begin : cut.start()]
        begin = cut.start()
    yield data[begin:]


def unused(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that no column has (letters' case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
