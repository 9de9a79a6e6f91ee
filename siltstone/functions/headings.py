"""Headings above a place in a text."""

from __future__ import annotations


class Trail:
    """The names of the headings that a text stands under, outermost first, kept while headings are read in order."""

    def __init__(self):
        self.names: dict[int, str] = {}

    def under(self, level: int, name: str) -> tuple[str, ...]:
        """The trail once a heading of this level has been read: it ends those of its own level and below."""
        for deeper in [n for n in self.names if n >= level]:
            del self.names[deeper]
        self.names[level] = name
        return tuple(self.names.values())
