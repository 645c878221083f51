"""A bounded store of what was worked out for words, kept by a worker process."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Memo:
    """Entries by key in two generations.

    A full generation becomes the old one, and old entries that are met again come back, so frequent keys stay while
    rare ones go. About twice ``limit`` entries are held at most; one call may exceed it by its own keys.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.current: dict = {}
        self.old: dict = {}

    def lookup(self, lists: list[list], learn: Callable[[list], Iterable]) -> list[list]:
        """The entries of each list; ``learn`` gives those of unknown keys, in their order. None is no entry."""
        if len(self.current) > self.limit:
            self.old, self.current = self.current, {}
        current, old, missing = self.current, self.old, set()
        found = [list(map(current.get, keys)) for keys in lists]
        for keys, entries in zip(lists, found, strict=True):
            if None in entries:
                missing.update([k for k, e in zip(keys, entries, strict=True) if e is None])
        if not missing:
            return found
        new = []
        for key in missing:
            entry = old.get(key)
            if entry is None:
                new.append(key)
            else:
                current[key] = entry
        current.update(zip(new, learn(new), strict=True))
        return [
            [current[k] if e is None else e for k, e in zip(keys, entries, strict=True)] if None in entries else entries
            for keys, entries in zip(lists, found, strict=True)]
