"""Periodic runs of words by internal pattern matching.

A run with period q is at least 4 q words long, so with B the smallest power of two that is at least q (and at least
four), one of the blocks of B words that start at multiples of B / 2 lies in it together with its copy q words later;
and as B >= q, the block's next occurrence in the text is that copy.  So it is enough to ask, for each dyadic block, where
it occurs next in the window of B words behind it:

* Blocks of 4, 8, 16, ... words are named by doubling; blocks of one name are neighbours in the suffix array.
* A wavelet matrix over the suffix array answers the range successor: the least position in the block's part of the array
  that is larger than its own.  It is asked for all blocks at once.
* The distance to it is the smallest difference of the progression of the block's occurrences: the candidate period.
  Candidates are extended in both directions and those of fewer than 4 periods are let go.

Names are of a word *in its document*, so that texts of one batch never meet, and blocks that occur once in their
document leave the doubling at once: nearly all of natural text after its first step.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run holds so many periods and words at least.  The search needs four periods.
PERIODS, LEAST_WORDS = 4, 6
#: Words whose suffixes are sorted together; a longer text is sorted alone.
TOGETHER = 200_000
#: Length of the shortest blocks; they find periods up to their own length.
SHORTEST = 4
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class WaveletMatrix:
    """Range successor over a permutation: for many ranges and bounds at a time."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in range(max(int(len(values) - 1).bit_length(), 1) - 1, -1, -1):
            ones = (values >> bit) & 1
            zeros = np.concatenate(([0], np.cumsum(1 - ones)))
            self.levels.append((bit, zeros))
            values = np.concatenate((values[ones == 0], values[ones == 1]))

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of [lo, hi) are less than the bound, which is a value of the permutation."""
        out = np.zeros(len(lo), dtype=np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            one = (bound >> bit) & 1 == 1
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return out

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of [lo, hi)."""
        out = np.zeros(len(lo), dtype=np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            one = k >= b - a
            out += np.where(one, 1 << bit, 0)
            k = np.where(one, k - (b - a), k)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return out


def _repeated_blocks(text: np.ndarray, doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions of the shortest blocks that occur again in their document; a few more where hashes collide."""
    n = len(text) - SHORTEST + 1
    if n < 2:
        return np.empty(0, dtype=np.int64)
    key = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(SHORTEST):
        key = (key ^ text[j : n + j].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    inside = np.arange(n) + SHORTEST <= end[:n]
    ordered = np.sort(key[inside])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.empty(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return np.flatnonzero(inside & (twice[at] == key))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the index of each one's group's first row, and the group's size."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(new)))
    return np.repeat(first, sizes), np.repeat(sizes, sizes)


def candidates(text: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block start, distance to its next occurrence, block length) of all dyadic blocks that occur again within their length.

    ``text`` holds the symbols of several documents one after the other, ``doc`` each one's document and ``end`` where
    that ends.
    """
    none = (np.empty(0, dtype=np.int64),) * 3
    members = _repeated_blocks(text, doc, end)
    if not len(members):
        return none
    keys = [text[members + j] for j in range(SHORTEST - 1, -1, -1)]
    order = np.lexsort((*keys, doc[members]))
    members = members[order]
    first, size = _groups(*[k[order] for k in keys], doc[members])
    suffixes, slots = members.copy(), np.arange(len(members))
    name = -2 - np.arange(len(text))  # a block that never was repeated has a name of its own
    name[members] = first
    asked, block = [], SHORTEST
    longest = int(np.bincount(doc).max())
    while True:
        again = size > 1
        members, slots, first, size = members[again], slots[again], first[again], size[again]
        here = members % (block // 2) == 0
        asked.append((members[here], first[here], size[here], np.full(int(here.sum()), block)))
        if not len(members) or 2 * block > longest // 2:
            break
        # a block of twice the length: this one and the one behind it; groups keep their part of the suffix array
        behind = members + block
        second = np.where(behind < len(text), name[np.minimum(behind, len(text) - 1)], -1)
        order = np.lexsort((second, first))
        members, lead, second = members[order], first[order], second[order]
        start, size = _groups(lead, second)
        first = slots[start]
        suffixes[slots] = members
        name[members] = first
        block *= 2
    at, lo, size, length = (np.concatenate(x) for x in zip(*asked, strict=True))
    if not len(at):
        return none
    places = np.sort(suffixes)
    tree = WaveletMatrix(np.searchsorted(places, suffixes))
    own, hi = np.searchsorted(places, at), lo + size
    upto = tree.below(lo, hi, own) + 1  # its own place is in the range
    more = upto < size
    at, lo, hi, length = at[more], lo[more], hi[more], length[more]
    gap = places[tree.smallest(lo, hi, upto[more])] - at
    # gaps up to half the length are those of shorter blocks
    near = (gap <= length) & ((gap > length // 2) | (length == SHORTEST))
    return at[near], gap[near], length[near]


def _agree(text: np.ndarray, at: int, gap: int, stop: int) -> int:
    """The first position from ``at`` on whose word differs from the one ``gap`` later, at most ``stop - gap``."""
    step, last = 32, stop - gap
    while at < last:
        to = min(at + step, last)
        same = text[at:to] == text[at + gap : to + gap]
        if not same.all():
            return at + int(np.argmin(same))
        at, step = to, step * 2
    return last


def _agree_back(text: np.ndarray, at: int, gap: int, start: int) -> int:
    """The smallest position up to ``at`` from which all words before ``at`` agree with those ``gap`` later."""
    step = 32
    while at > start:
        to = max(at - step, start)
        same = text[to:at] == text[to + gap : at + gap]
        if not same.all():
            return at - int(np.argmin(same[::-1]))
        at, step = to, step * 2
    return start


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), by start and period."""
    table: dict = defaultdict(count().__next__)
    sizes = np.array([len(ws) for ws in texts], dtype=np.int64)
    text = np.fromiter(map(table.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(sizes.sum()))
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at, gap, length = candidates(text, doc, ends[doc] if len(doc) else doc)
    order = np.lexsort((at, gap))
    last_gap, covered = 0, 0
    for p, q, b in zip(at[order].tolist(), gap[order].tolist(), length[order].tolist(), strict=True):
        if q == last_gap and p < covered:
            continue
        d = int(doc[p])
        stop = int(ends[d])
        begin = stop - int(sizes[d])
        left, right = _agree_back(text, p, q, begin), _agree(text, p + b, q, stop)
        last_gap, covered = q, right
        if right - left + q >= max(LEAST_WORDS, PERIODS * q):
            found[d].append((left - begin, right - left + q, q))
    for rs in found:
        rs.sort(key=lambda x: (x[0], x[2]))
    return found


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    kept, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        if b > at:
            kept += words[at : max(a, at)]
            at = b
    return kept + words[at:]


def periodic_runs(docs: DataFrame, *, together: int = TOGETHER) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, ...): doc_id, n_words, runs (array of start, length, period) and collapsed.

    A run is a stretch of words (between ASCII white space) with smallest period q, at least six words and 4 q long, that no
    neighbouring word extends; ``collapsed`` is the text without what runs hold behind their first q words, single spaced.

    * Null and empty texts have no words, no runs and an empty ``collapsed``.  Null and repeated doc_ids: each row is
      its own.  Of overlapping runs a word goes if any of them drops it.
    * Texts may have any length: a long one is searched alone, in memory that grows with its words.
    * Other columns are ignored, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            lo = 0
            while lo < batch.num_rows:
                texts, total, hi = [], 0, lo
                while hi < batch.num_rows and total < together:
                    words = (raw[hi].as_py() or b"").split()
                    texts.append(words)
                    total += len(words)
                    hi += 1
                found = runs_of(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(ws) for ws in texts], pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": q} for s, n, q in rs] for rs in found], pa.list_(_RUN)),
                        pa.array([b" ".join(collapse(ws, rs)) for ws, rs in zip(texts, found, strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )
                lo = hi

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
