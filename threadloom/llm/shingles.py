"""Shingle sets of a slice of whole texts with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from threadloom.llm.wordgrid import Words, mix, run_hashes


@dataclass
class Sets:
    """values: hashes by text, sorted and distinct; first: each text's first value, with an end."""

    values: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.first[i] : self.first[i + 1]]

    def prints(self, salt: int) -> np.ndarray:
        """A 64-bit print of each set, signed."""
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.values + np.uint64(salt)), dtype=np.uint64)])
        return mix(total[self.first[1:]] - total[self.first[:-1]]).view(np.int64)


def shingle_sets(words: Words, size: int) -> Sets:
    """Distinct shingles of ``size`` lower-cased words; fewer words are one shingle, none is the empty set."""
    hashes, counts = words.hashes(lower=True), words.counts
    number = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    owner = np.repeat(np.arange(len(counts)), number)
    start = np.arange(len(owner)) - (np.cumsum(number) - number)[owner] + words.first[:-1][owner]
    values = np.empty(len(owner), dtype=np.uint64)
    for n in range(1, size + 1):
        at = np.flatnonzero(counts[owner] == n if n < size else counts[owner] >= size)
        if len(at):
            values[at] = run_hashes(hashes, n)[start[at]]
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    keep = np.ones(len(owner), dtype=bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[keep], values[keep]
    return Sets(values, np.searchsorted(owner, np.arange(len(counts) + 1)))
