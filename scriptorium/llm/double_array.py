"""A double-array trie over dense codes: the child of state ``s`` by code ``c`` stands at ``base[s] + c``
and names ``s`` in ``check``, so a step is two reads and no search."""

from __future__ import annotations

import numpy as np

ROOT = 0
FREE = -1


class DoubleArray:
    """Packed from sequences in lexicographic order; each of ``sequences`` is a list of codes from 0 on."""

    def __init__(self, sequences: list[list[int]]):
        self.base, self.check = [0], [ROOT]
        self._next = 1  # no slot below it is free
        #: states in the order in which they were made: parents first
        self.states = [ROOT]
        # the rows below each state of one depth at a time, in order
        level = [(ROOT, 0, len(sequences))] if sequences else []
        depth = 0
        while level:
            below = []
            for state, low, high in level:
                starts: list[int] = []
                codes: list[int] = []
                for k in range(low, high):
                    if len(sequences[k]) > depth and (not codes or sequences[k][depth] != codes[-1]):
                        codes.append(sequences[k][depth])
                        starts.append(k)
                if codes:
                    for child, a, b in zip(self._place(state, codes), starts, [*starts[1:], high], strict=True):
                        below.append((child, a, b))
            level, depth = below, depth + 1

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size - len(self.check), len(self.check))
            self.base += [0] * more
            self.check += [FREE] * more

    def _place(self, state: int, codes: list[int]) -> list[int]:
        """Set BASE of ``state`` so that all children fall on free slots, the first fit."""
        while self._next < len(self.check) and self.check[self._next] != FREE:
            self._next += 1
        least, span = min(codes), max(codes) - min(codes)
        slot = self._next
        while True:
            self._grow(slot + span + 1)
            if self.check[slot] == FREE and all(self.check[slot + c - least] == FREE for c in codes):
                break
            slot += 1
        self.base[state] = slot - least
        out = [slot + c - least for c in codes]
        for t in out:
            self.check[t] = state
        self.states += out
        return out

    def step(self, state: int, code: int) -> int:
        """The child, or -1."""
        t = self.base[state] + code
        return t if t != ROOT and 0 <= t < len(self.check) and self.check[t] == state else -1

    def walk(self, sequence: list[int]) -> list[int]:
        """The states along a sequence, from the root on."""
        state, out = ROOT, [ROOT]
        for code in sequence:
            state = self.step(state, code)
            if state < 0:
                raise KeyError(code)
            out.append(state)
        return out

    def density(self) -> float:
        """The share of slots in use, up to the last one."""
        used = np.flatnonzero(np.array(self.check) != FREE)
        return len(used) / (used[-1] + 1)
