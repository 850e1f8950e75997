"""A bounded memory of computed values that keeps what is in use."""

from __future__ import annotations


class Memo(dict):
    """Two generations of at most ``limit`` entries; a used entry moves to the younger one.

    It bounds memory, never results: what was forgotten is made again.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def make(self, key):
        raise NotImplementedError

    def known(self, key) -> bool:
        return key in self or key in self.older

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
