"""Different names in the state of a stream."""

from __future__ import annotations

import json

#: Names that stand beside the counters of a process; any further ones are keys of a map.
FEW = 64


class Names:
    """Names met by a process: the first FEW as one text, any others in a map of the state.

    The map is asked only once the text is full, so a process of few names
    costs no call for any of them.
    """

    def __init__(self, store, held: str | None):
        self.store = store
        self.held = [tuple(x) for x in json.loads(held)] if held else []
        # Names met in this call need no second look at the state store.
        self.known = set(self.held)

    def add(self, name: tuple) -> bool:
        """Whether the name is new."""
        if name in self.known:
            return False
        self.known.add(name)
        if len(self.held) < FEW:
            self.held.append(name)
            return True
        if self.store.containsKey(name):
            return False
        self.store.updateValue(name, (True,))
        return True

    def clear(self) -> None:
        self.held, self.known = [], set()
        self.store.clear()

    def packed(self) -> str:
        return json.dumps(self.held)
