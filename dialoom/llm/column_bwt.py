"""Burrows-Wheeler transform and common prefixes of a collection, built one column at a time in sequential files."""

from __future__ import annotations

import os
import tempfile

import numpy as np


class _File:
    """An array on disk that is read from front to back and written anew each round."""

    def __init__(self, folder: str, name: str, kind: type):
        self.file, self.kind = open(os.path.join(folder, name), "w+b", buffering=0), kind

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), dtype=self.kind)

    def write(self, values: np.ndarray) -> None:  # arrays only grow
        self.file.seek(0)
        self.file.write(values.astype(self.kind, copy=False))


def repeated_suffixes(strings: list[bytes], length: int) -> np.ndarray:
    """For each position of the strings, laid end to end: does another suffix share its first `length` bytes?

    The collection's suffixes are sorted by inserting, in each round, one more symbol of every string from
    its end: the symbol before a suffix gives the place of the longer one by its rank (LF mapping). The
    transform (a number for each symbol, 0 where a string begins) and the common prefix of each suffix with the
    one before it (up to `length`, at most 255) live in files that a round reads and writes sequentially. The
    common prefix of two neighbours that start alike is one more than the least between their tails.
    """
    if not 0 < length < 255:
        raise ValueError("length is 1 to 254")
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    m, offsets = len(strings), np.concatenate(([0], np.cumsum(sizes)))
    flags = np.zeros(offsets[-1], dtype=bool)
    if not offsets[-1]:
        return flags
    text = np.frombuffer(b"".join(strings), dtype=np.uint8)
    there = np.flatnonzero(np.bincount(text, minlength=256))
    kind = np.uint8 if len(there) < 256 else np.uint16
    number = np.zeros(256, dtype=kind)
    number[there] = np.arange(1, len(there) + 1)

    def before(of: np.ndarray, done: int) -> np.ndarray:
        """The symbol before the last `done` of each string; 0 at its start."""
        at = offsets[of] + sizes[of] - done - 1
        inside = sizes[of] > done
        return np.where(inside, number[text[np.maximum(at, 0)]], kind(0))

    with tempfile.TemporaryDirectory() as folder:
        bwt, lcp = _File(folder, "bwt", kind), _File(folder, "lcp", np.uint8)
        bwt.write(before(np.arange(m), 0))
        lcp.write(np.zeros(m, dtype=np.uint8))
        active, place = np.arange(m), np.arange(m)  # strings that grow, and where their longest suffix lies
        for done in range(1, int(sizes.max()) + 1):
            grow = sizes[active] >= done
            active, place = active[grow], place[grow]
            b, a = bwt.read(), lcp.read()
            order = np.argsort(b, kind="stable")[np.count_nonzero(b == 0) :]  # entries with a symbol, by symbol and place: the longer suffixes in order
            n = len(order)
            marked = np.zeros(len(b), dtype=bool)
            marked[place] = True
            r = np.flatnonzero(marked[order])  # their ranks, by symbol and place
            new = np.zeros(m + n, dtype=bool)
            new[m + r] = True
            # Common prefixes: of each new suffix with the one before it, and of the one after it with it.
            touched = np.zeros(n + 1, dtype=bool)
            touched[r] = touched[r + 1] = True
            touched = np.flatnonzero(touched[:n])
            here, last = order[touched], order[touched - 1]
            alike = (b[here] == b[last]) & (touched > 0)
            fresh = np.zeros(len(touched), dtype=np.uint8)
            if alike.any():
                by = np.argsort(last[alike])
                ends = np.empty(2 * len(by), dtype=np.int64)
                ends[0::2], ends[1::2] = last[alike][by] + 1, here[alike][by] + 1
                least = np.minimum.reduceat(np.append(a, np.uint8(0)), ends)[0::2]
                fresh[np.flatnonzero(alike)[by]] = np.minimum(least, length - 1) + 1
            longer = np.empty(m + n, dtype=kind)
            prefix = np.empty(m + n, dtype=np.uint8)
            longer[~new], prefix[~new] = b, a
            own = np.empty(len(b), dtype=np.int32)
            own[place] = np.arange(len(place))
            by = own[order[r]]  # whose suffix each is
            active = active[by]
            place = m + r
            longer[place] = before(active, done)
            prefix[m + touched] = fresh
            bwt.write(longer)
            lcp.write(prefix)
        b, a = bwt.read(), lcp.read()
    shared = a >= length
    shared[:-1] |= shared[1:]
    order = np.argsort(b, kind="stable")[np.count_nonzero(b == 0) :]
    step = np.empty(len(b), dtype=np.int64)
    step[order] = m + np.arange(len(order))
    active, place = np.arange(m), np.arange(m)
    for done in range(1, int(sizes.max()) + 1):
        grow = sizes[active] >= done
        active, place = active[grow], step[place[grow]]
        flags[offsets[active] + sizes[active] - done] = shared[place]
    return flags
