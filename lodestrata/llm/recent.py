"""A bounded memory for what Python workers compute again and again."""

from __future__ import annotations

from collections.abc import Callable

LONGEST = 256


class Recent(dict):
    """Values by key (strings), made when first asked for. Keeps the ``size`` newest and those of them and the ``size`` before
    that are asked for; what belongs to a key of over LONGEST characters is made each time, so that bytes are bounded too."""

    def __init__(self, make: Callable, size: int) -> None:
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        value = self.older.get(key)
        return self.keep(key, self.make(key) if value is None else value)

    def keep(self, key, value):
        """Takes in a value that was made elsewhere."""
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
