"""A cuckoo filter over 128-bit digests: sixteen-bit fingerprints, four to a bucket, with deletion."""

from __future__ import annotations

import numpy as np

from rolecast.llm import textbytes as tb

SLOTS = 4
KICKS = 500
LOAD = 0.84


class Full(Exception):
    """No free slot after ``KICKS`` moves; the filter is unchanged and wants to be made anew, larger."""


def split(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place, fingerprint) of each digest; a fingerprint is never 0, which marks a free slot."""
    halves = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return halves[:, 0], (halves[:, 1] % np.uint64(65535)).astype(np.uint16) + np.uint16(1)


class CuckooFilter:
    """Fingerprints of a multiset of digests.  What was added is found; what was not is found about once in 8000 times."""

    def __init__(self, capacity: int = 0, cells: bytes | None = None):
        if cells is not None:
            self.cells = np.frombuffer(cells, np.uint16).reshape(-1, SLOTS).copy()
        else:
            buckets = 1 << max(0, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * LOAD)))))
            self.cells = np.zeros((buckets, SLOTS), np.uint16)
        self.mask = len(self.cells) - 1

    def _jump(self, fingerprint) -> np.ndarray:
        """Distance, as bits to flip, between the two buckets of a fingerprint."""
        return tb.mix(np.asarray(fingerprint, np.uint64) + np.uint64(7)).astype(np.int64) & self.mask

    def contains(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, bool)
        place, mark = split(digests)
        first = (place & np.uint64(self.mask)).astype(np.int64)
        second = first ^ self._jump(mark)
        return ((self.cells[first] == mark[:, None]) | (self.cells[second] == mark[:, None])).any(axis=1)

    def _put(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.cells[bucket] == 0)
        if len(free):
            self.cells[bucket, free[0]] = mark
        return bool(len(free))

    def add(self, digests: list[bytes]) -> "CuckooFilter":
        if not digests:
            return self
        before = self.cells.copy()
        places, marks = split(digests)
        firsts = (places & np.uint64(self.mask)).astype(np.int64)
        for bucket, mark, jump in zip(firsts.tolist(), marks.tolist(), self._jump(marks).tolist()):
            if self._put(bucket, mark) or self._put(bucket ^ jump, mark):
                continue
            for kick in range(KICKS):
                slot = (kick * 7 + mark) % SLOTS
                mark, self.cells[bucket, slot] = int(self.cells[bucket, slot]), mark
                bucket ^= int(self._jump(mark))
                if self._put(bucket, mark):
                    break
            else:
                self.cells = before
                raise Full
        return self

    def remove(self, digests: list[bytes]) -> "CuckooFilter":
        """Takes one fingerprint away for each digest; only what was added may be removed."""
        if digests:
            places, marks = split(digests)
            firsts = (places & np.uint64(self.mask)).astype(np.int64)
            for bucket, mark, jump in zip(firsts.tolist(), marks.tolist(), self._jump(marks).tolist()):
                for b in (bucket, bucket ^ jump):
                    at = np.flatnonzero(self.cells[b] == mark)
                    if len(at):
                        self.cells[b, at[0]] = 0
                        break
        return self

    def tobytes(self) -> bytes:
        return self.cells.tobytes()


def filled(digests: list[bytes]) -> CuckooFilter:
    """A filter of all ``digests``, as large as it needs to be."""
    capacity = max(8, len(digests))
    while True:
        try:
            return CuckooFilter(capacity).add(digests)
        except Full:
            capacity *= 2
