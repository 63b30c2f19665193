"""A cuckoo filter over 128-bit keys, vectorised in numpy: insertion, look-up and deletion of many keys at once.

After Fan et al. 2014. A key leaves a 16-bit fingerprint in one of two buckets of four places; either bucket follows from
the other and the fingerprint, so a fingerprint can move without its key. A key that was inserted is always found; one that
was not is found with a chance of at most 8 in 65,535. Only keys that are held may be deleted, and a key is inserted once:
how many documents hold it is for the exact table beside the filter. A filter does not grow, for a larger one needs the
keys again: ``insert`` says so when there is no room.

Keys come as two uint64 columns of evenly spread bits. The same calls give the same bytes, so a task that runs again gives
the same filter.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
LOAD = 0.9  # share of the places that may be taken
MAX_ROUNDS = 500
MIN_BUCKETS = 64


class Full(Exception):
    """No room left: the filter has to be built anew from the keys it holds."""


def _places(sorted_groups: np.ndarray) -> np.ndarray:
    """Number of each item within its run of equal values."""
    spots = np.arange(len(sorted_groups))
    starts = np.ones(len(sorted_groups), dtype=bool)
    starts[1:] = sorted_groups[1:] != sorted_groups[:-1]
    return spots - np.maximum.accumulate(np.where(starts, spots, 0))


class CuckooFilter:
    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """An empty filter with room for so many keys."""
        buckets = MIN_BUCKETS
        while buckets * SLOTS * LOAD < keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def _buckets(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = np.maximum(high >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        first = (low & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        mark, first, second = self._buckets(high, low)
        return ((self.table[first] == mark[:, None]) | (self.table[second] == mark[:, None])).any(axis=1)

    def insert(self, high: np.ndarray, low: np.ndarray) -> None:
        """Add distinct keys that are not held: round by round each takes a free place or drives out what is there."""
        table = self.table
        if len(self) + len(high) > LOAD * table.size:
            raise Full
        mark, first, second = self._buckets(high, low)
        at = np.where(np.count_nonzero(table[first], axis=1) <= np.count_nonzero(table[second], axis=1), first, second)
        for turn in range(MAX_ROUNDS):
            if not len(at):
                return
            order = np.argsort(at, kind="stable")
            at, mark = at[order], mark[order]
            free = table[at] == 0
            rank = _places(at)
            fits = rank < free.sum(axis=1)
            place = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), rank[fits]]
            table[at[fits], place] = mark[fits]
            at, mark = at[~fits], mark[~fits]
            # the first of those that wait at a bucket drives out a fingerprint; the others try their other bucket
            heads = _places(at) == 0
            slot = (mark[heads].astype(np.int64) + turn) % SLOTS
            driven = table[at[heads], slot]
            table[at[heads], slot] = mark[heads]
            mark[heads] = driven
            at = self._other(at, mark)
        raise Full

    def delete(self, high: np.ndarray, low: np.ndarray) -> None:
        """Take out keys that are held, one fingerprint for each."""
        mark, first, second = self._buckets(high, low)
        gone = self._take(first, mark)
        mark, second = mark[~gone], second[~gone]
        mark = mark[~self._take(second, mark)]
        if len(mark):
            raise KeyError(f"{len(mark)} keys to delete are not held")

    def _take(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        order = np.lexsort((mark, at))
        rank = _places(at[order] * 65536 + mark[order])
        same = self.table[at[order]] == mark[order][:, None]
        hit = rank < same.sum(axis=1)
        place = np.argsort(~same[hit], axis=1, kind="stable")[np.arange(int(hit.sum())), rank[hit]]
        self.table[at[order][hit], place] = 0
        gone = np.zeros(len(at), dtype=bool)
        gone[order[hit]] = True
        return gone

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, "<u2").reshape(-1, SLOTS).astype(np.uint16))
