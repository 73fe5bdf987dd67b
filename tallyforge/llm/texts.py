"""Helpers for tasks that read texts in Python: bounded slices and Arrow columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Characters of a long text that are handled at a time.
SLICE = 1 << 20


def slices(text: str, boundary: re.Pattern, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at (and without) matches of ``boundary``.

    Where no boundary follows, the rest is one part.
    """
    at = 0
    while len(text) - at > size and (cut := boundary.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def byte_level() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: visible Latin-1 stands for itself, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Recent:
    """A bounded table of what was computed lately: two generations, the older one dropped when the younger is full.

    What is asked for again moves to the younger generation, so frequent keys stay.
    """

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def keep(self, key, value):
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        self.young[key] = value
        return value

    def again(self, key):
        """The value of a key that the younger generation lacks, or None."""
        found = self.old.get(key)
        return None if found is None else self.keep(key, found)
