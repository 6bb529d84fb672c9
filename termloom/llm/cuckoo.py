"""A cuckoo filter with vectorised insertion, lookup and deletion.

A key is two 64-bit hashes: the first gives the bucket, the second a 16-bit fingerprint.
Every key has two buckets of four slots; the second bucket follows from the first and the
fingerprint, so an entry can be moved, and removed again, without its key.
"""

from __future__ import annotations

import numpy as np

from termloom.llm.textkernel import mix

U64 = np.uint64
SLOTS = 4
LOAD = 0.8


class CuckooFilter:
    def __init__(self, capacity: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / LOAD / SLOTS))))
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table = table

    @property
    def capacity(self) -> int:
        return int(self.table.size * LOAD)

    @property
    def entries(self) -> int:
        return int(np.count_nonzero(self.table))

    def _home(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = U64(len(self.table) - 1)
        mark = (mix(k2.view(U64)) >> U64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return (mix(k1.view(U64)) & mask).astype(np.int64), mark

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(U64)) & U64(len(self.table) - 1)).astype(np.int64)

    def insert(self, k1: np.ndarray, k2: np.ndarray, max_rounds: int = 2000) -> None:
        """Adds keys (each once, none held already)."""
        bucket, mark = self._home(k1, k2)
        turn = 0
        while len(bucket):
            for side in (bucket, None):
                where = side if side is not None else self._other(bucket, mark)
                left = np.ones(len(where), bool)
                for slot in range(SLOTS):
                    free = np.flatnonzero(left & (self.table[where, slot] == 0))
                    _, pick = np.unique(where[free], return_index=True)
                    pick = free[pick]
                    self.table[where[pick], slot] = mark[pick]
                    left[pick] = False
                bucket, mark = bucket[left], mark[left]
            if not len(bucket):
                return
            # both buckets full: take one entry's place in each bucket, and go on with that entry
            turn += 1
            if turn > max_rounds:
                raise OverflowError("the filter is over its capacity")
            at = self._other(bucket, mark) if turn % 2 else bucket
            _, pick = np.unique(at, return_index=True)
            slot = (mix(at[pick].astype(U64) + U64(turn)) & U64(SLOTS - 1)).astype(np.int64)
            out = self.table[at[pick], slot].copy()
            self.table[at[pick], slot] = mark[pick]
            mark[pick], bucket[pick] = out, self._other(at[pick], out)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """True for every key held; false positives come at some 1 in 8,000."""
        bucket, mark = self._home(k1, k2)
        hit = (self.table[bucket] == mark[:, None]).any(1)
        return hit | (self.table[self._other(bucket, mark)] == mark[:, None]).any(1)

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Removes one entry for each key; every key must be held."""
        bucket, mark = self._home(k1, k2)
        for side in (0, 1):  # what the home bucket does not hold is in the other one
            where = self._other(bucket, mark) if side else bucket
            left = np.arange(len(where))
            while len(left):
                match = self.table[where[left]] == mark[left, None]
                left, slot = left[match.any(1)], match.argmax(1)[match.any(1)]
                # keys with the same bucket and mark take their entries one a turn
                _, pick = np.unique(where[left] * SLOTS + slot, return_index=True)
                self.table[where[left[pick]], slot[pick]] = 0
                mark[left[pick]] = 0
                left = np.delete(left, pick)
            keep = mark > 0
            bucket, mark = bucket[keep], mark[keep]
