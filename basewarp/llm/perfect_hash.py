"""A minimal perfect hash over distinct 32-byte digests, built level by level.

Each level hashes the keys still unplaced into a bit array 1.3 times their number;
keys alone in their cell are placed, the others go down a level.  A placed key's slot
is the rank of its cell among all set cells, so n keys fill slots 0 to n-1.  A key that
was never placed may get a slot too: callers compare the full digest kept there.
"""

from __future__ import annotations

import numpy as np

from .common import mixed

SPREAD, LEVELS = 1.3, 24


class PerfectHash:
    def __init__(self, digests: np.ndarray):
        """digests: (n, 32) uint8, distinct."""
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        left = np.arange(len(digests))
        keys = self._keys(digests)
        self.rest: dict[bytes, int] = {}
        while len(left) and len(self.levels) < LEVELS:
            cells = max(64, int(len(left) * SPREAD))
            at = self._cell(keys[left], len(self.levels), cells)
            alone = np.bincount(at, minlength=cells) == 1
            self.levels.append((alone, np.cumsum(alone) - alone + self.size))
            self.size += int(alone.sum())
            left = left[~alone[at]]
        for i in left:  # equal in all hashed bytes, or very unlucky
            self.rest[digests[i].tobytes()] = self.size
            self.size += 1

    @staticmethod
    def _keys(digests: np.ndarray) -> np.ndarray:
        parts = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
        return mixed(parts[:, 0] ^ mixed(parts[:, 1] ^ mixed(parts[:, 2] ^ mixed(parts[:, 3]))))

    @staticmethod
    def _cell(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
        return (mixed(keys + np.uint64(0x632BE59BD9B4E019 * (level + 1) & (1 << 64) - 1)) % np.uint64(cells)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where no level has one."""
        out = np.full(len(digests), -1, dtype=np.int64)
        if not len(digests):
            return out
        keys, left = self._keys(digests), np.arange(len(digests))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._cell(keys[left], level, len(alone))
            here = alone[at]
            out[left[here]] = rank[at[here]]
            left = left[~here]
        if self.rest:
            for i in left:
                out[i] = self.rest.get(digests[i].tobytes(), -1)
        return out
