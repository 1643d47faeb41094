"""A minimal perfect hash over 128-bit digests: n distinct digests get the slots 0 to n - 1.

Digests that fall alone into a cell of a level's bit array take that cell; the others go on to the
next level with another seed.  The slot is the rank of the cell among all cells taken.  The table
keeps the digest of every slot, so a look-up is verified and an unknown digest raises.
"""

from __future__ import annotations

import numpy as np

from cohortlens.llm.common import mix

#: Cells of a level for each digest still to be placed.
SPREAD = 1.5


def distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct digests, given as two 64-bit words each."""
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.ones(len(high), dtype=bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    return high[new], low[new]


class SlotTable:
    """Slots of distinct digests (two equal-length uint64 arrays)."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.levels: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        self.high, self.low = np.empty_like(high), np.empty_like(low)
        left, taken, seed = np.arange(len(high)), 0, 0
        while len(left):
            cells = max(64, int(SPREAD * len(left)))
            at = self._cell(high[left], low[left], np.uint64(seed), cells)
            alone = np.bincount(at, minlength=cells) == 1
            rank = taken + np.cumsum(alone) - alone
            self.levels.append((np.uint64(seed), alone, rank))
            placed = alone[at]
            self.high[rank[at[placed]]] = high[left[placed]]
            self.low[rank[at[placed]]] = low[left[placed]]
            taken, left, seed = taken + int(placed.sum()), left[~placed], seed + 1

    def __len__(self) -> int:
        return len(self.high)

    @staticmethod
    def _cell(high: np.ndarray, low: np.ndarray, seed: np.uint64, cells: int) -> np.ndarray:
        return (mix(low ^ mix(high + mix(np.full(1, seed + np.uint64(1), np.uint64)))) % np.uint64(cells)).astype(np.int64)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of every digest, compared with the digest kept there."""
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for seed, alone, rank in self.levels:
            at = self._cell(high[left], low[left], seed, len(alone))
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        if len(left) or (self.high[out] != high).any() or (self.low[out] != low).any():
            raise ValueError("a digest without a slot")
        return out
