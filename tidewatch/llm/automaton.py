"""Suffix automata over word sequences, with the number of places at which each factor ends."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """Of any number of sequences, each with a weight: how often it stands in the corpus."""

    def __init__(self, sequences: Iterable[tuple[Sequence[Hashable], int]]):
        self.length, self.link, self.next = [0], [-1], [{}]
        self.ends = [0]
        for seq, weight in sequences:
            last = 0
            for x in seq:
                last = self._add(last, x)
                self.ends[last] += weight
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for v in order:
            if self.link[v] > 0:
                self.ends[self.link[v]] += self.ends[v]

    def _state(self, length: int, link: int, then: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(then)
        self.ends.append(0)
        return len(self.length) - 1

    def _split(self, p: int, x: Hashable) -> int:
        """The state of the longest factor of p followed by x; a clone if longer ones share it."""
        q = self.next[p][x]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, x: Hashable) -> int:
        if x in self.next[last]:
            return self._split(last, x)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, x)
        return new

    def repeated(self, seq: Sequence[Hashable], window: int) -> list[int]:
        """Starts of the windows of this length in seq that end at two or more places of the corpus. The matching
        statistic at each position is kept to the window's length by going up suffix links."""
        state, n, out = 0, 0, []
        length, link, then, ends = self.length, self.link, self.next, self.ends
        for i, x in enumerate(seq):
            while state and x not in then[state]:
                state = link[state]
                n = length[state]
            if x in then[state]:
                state, n = then[state][x], n + 1
            while state and length[link[state]] >= window:
                state = link[state]
                n = length[state]
            if n >= window and ends[state] >= 2:
                out.append(i - window + 1)
        return out
