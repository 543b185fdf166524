"""Best-fit packing of token sequences with exact complements.

Documents become token ids and pieces of at most ``capacity`` tokens.  Only the histogram of piece lengths (at most
``capacity`` rows, whatever the corpus) goes to the driver, where runs are planned: a run is a pattern of lengths and
how often it is used.  For the longest length left, the gap is closed exactly by one, two or three lengths whose sum is
the gap, found in an index of sums (:class:`Lengths`), as long as their counts last; where no such sum is left, the
best-fitting length goes in and the search goes on.
Pieces then find their place from their rank among pieces of their length, which two-level counting gives without
sorting a length in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import staged

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces of one length that are ranked in one task: a length is dealt to as many buckets as its count needs.
RANKED = 20_000
#: Cached words of a Python worker; beyond it the cache starts anew.
CACHE_WORDS, SHORT_WORD = 800_000, 8
#: Bytes of UTF-8 for all code points up to U+017F.
_LATIN = bytes([*range(0xC0), *range(0xC2, 0xC6)])
_ENCODERS: dict = {}


class WordEncoder:
    """Ids of texts by a tokenizer that never looks across white space, each distinct word encoded once.

    The vocabulary's normaliser lowers case and drops white space, so words between ASCII white space are encoded on
    their own.  Texts of Latin letters are lowered first, which the tokenizer would do anyway; texts with ``<|`` (special
    tokens) and others go to it as they are.  New words of letters alone go to the tokenizer many at a time and are told
    apart by the tokens that end a word; one mark after such a word is a word of its own for the tokenizer, too.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = {m: self._alone([m])[0] for m in ",.;:!?"}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        if len(self.ids) > CACHE_WORDS:  # short words are the frequent ones
            self.ids = {w: ids for w, ids in self.ids.items() if len(w) <= SHORT_WORD}
            if len(self.ids) > CACHE_WORDS // 2:
                self.ids = {}
        split = [_chunks(t) if t else [] for t in texts]
        found = [list(map(self.ids.get, ws)) for ws in split]
        gaps = [(k, [i for i, ids in enumerate(got) if ids is None]) for k, got in enumerate(found) if None in got]
        new = list({split[k][i] for k, places in gaps for i in places})
        marked: list[tuple[bytes, str, str]] = []
        plain, other = set(), []
        for raw in new:
            word = raw.decode("utf-8", "replace")
            if "İ" in word:  # its lower case is not of letters alone
                other.append(word)
            elif word.isalpha():
                plain.add(word)
            elif word[-1] in self.marks and word[:-1].isalpha():
                marked.append((raw, word[:-1], word[-1]))
                if word[:-1].encode() not in self.ids:
                    plain.add(word[:-1])
            else:
                other.append(word)
        for words, ids in ((sorted(plain), self._together), (other, self._alone)):
            for lo in range(0, len(words), 1000):
                part = words[lo : lo + 1000]
                self.ids.update(zip((w.encode("utf-8", "replace") for w in part), ids(part), strict=True))
        for raw, word, mark in marked:
            self.ids[raw] = self.ids[word.encode()] + self.marks[mark]
        for k, places in gaps:
            got, ws = found[k], split[k]
            for i in places:
                got[i] = self.ids[ws[i]]
        return [b"".join(got) for got in found]

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(words):  # letters that the tokenizer does not take for letters
            return self._alone(words)
        raw, at = ids.tobytes(), [0, *cuts.tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def _chunks(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "replace")
    if "<|" in text:
        return raw.split()
    if text.isascii():
        return raw.lower().split()
    # Latin letters up to U+017F go to lower case one by one, as in the tokenizer, all but the dotted capital I
    return raw.split() if "İ" in text or raw.translate(None, _LATIN) else text.lower().encode().split()


def _encoder(path: str | None) -> WordEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces_of(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if wanted, ids (binary, unsigned 32-bit)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import zlib

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = _encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        size = 4 * capacity
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):  # so that one batch of long texts stays small in Python
                part = batch.slice(lo, 512)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), size)):
                        piece = ids[at : at + size]
                        rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece), piece))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                n = 6 if keep_ids else 5
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], types[:n], strict=True)], names[:n])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class Lengths:
    """Counts by length, and an index of the sums of one, two and three of them.

    For each sum the index holds the largest part of the pair, and of the triple, that may still make it.  Counts only
    fall, so a pair or triple that is used up never comes back and these places only move down: no combination is
    looked at twice.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.pair_from = np.arange(capacity + 1)  # for each sum: no pair with a larger part is left
        self.triple_from = np.arange(capacity + 1)

    def largest(self, most: int) -> int:
        """The largest length left that is at most ``most``; 0 if none is."""
        there = np.flatnonzero(self.left[: most + 1])
        return int(there[-1]) if len(there) else 0

    def _pair(self, total: int, most: int) -> tuple[int, ...]:
        """Two lengths with this sum, the longer one as long as can be, up to ``most``."""
        half = (total + 1) // 2
        most = min(most, total - 1)
        if total < 2 or most < half:
            return ()
        both = (self.left[half : most + 1] > 0) & (self.left[total - most : total - half + 1][::-1] > 0)
        if total % 2 == 0:
            both[0] = self.left[half] > 1
        longer = np.flatnonzero(both)
        return () if not len(longer) else (int(longer[-1]) + half, total - int(longer[-1]) - half)

    def pair(self, total: int) -> tuple[int, ...]:
        found = self._pair(total, int(self.pair_from[total]))
        self.pair_from[total] = found[0] if found else 0
        return found

    def triple(self, total: int) -> tuple[int, ...]:
        for c in np.flatnonzero(self.left[: min(int(self.triple_from[total]), total - 2) + 1])[::-1].tolist() if total > 2 else []:
            if 3 * c < total:
                break
            self.left[c] -= 1
            found = self._pair(total - c, c)
            self.left[c] += 1
            if found:
                self.triple_from[total] = c
                return (c, *found)
        self.triple_from[total] = 0
        return ()

    def exact(self, gap: int) -> tuple[int, ...]:
        """One, two or three lengths that fill the gap exactly; empty if no such sum is left."""
        return (gap,) if self.left[gap] else self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (times, [(length, how many), ...]) that use up all lengths, no pattern being longer than the capacity."""
    lengths, runs = Lengths(counts, capacity), []
    while top := lengths.largest(capacity):
        pattern = [top]
        lengths.left[top] -= 1
        gap = capacity - top
        while gap:
            if not (more := lengths.exact(gap)):
                best = lengths.largest(gap)
                if not best:
                    break
                more = (best,)
            for x in more:
                lengths.left[x] -= 1
            pattern += more
            gap -= sum(more)
        used = {x: pattern.count(x) for x in dict.fromkeys(pattern)}
        again = min(int(lengths.left[x]) // n for x, n in used.items())
        for x, n in used.items():
            lengths.left[x] -= again * n
        runs.append((again + 1, list(used.items())))
    return runs


def _slots(runs: list, capacity: int) -> tuple[np.ndarray, ...]:
    """For each (run, length), sorted by length and first rank: key, first rank, first sequence, pieces a sequence, offset."""
    rows, ranks, sequence = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for times, pattern in runs:
        at = 0
        for length, n in pattern:
            rows.append((length, ranks[length], sequence, n, at))
            ranks[length] += times * n
            at += length * n
        sequence += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return (a[:, 0] << 44) + a[:, 1], a[:, 1], a[:, 2], a[:, 3], a[:, 4]


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text, ...) with sequence_id and offset (both long).

    * A document is its ids and then ``end_id``; null and empty texts are the end alone.  Only longer documents are
      cut, into pieces of ``capacity``; the last may be shorter.
    * Repeated rows, equal lengths and null ids are packed each on its own; ties are ranked by hash, doc_id and piece.
    * Other columns are ignored; an empty table gives no rows.
    """
    pieces = pieces_of(docs, tokenizer=tokenizer, end_id=end_id, capacity=capacity, keep_ids=keep_ids)
    # the place goes by row number too, so that repeated rows spread; it is written, so that ranks stand when a task runs again
    dealt = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(2**31 - 1)).cast("long").alias("dealt")
    pieces = staged(pieces.select("*", dealt))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    key, first, sequence, each, at = _slots(plan(counts, capacity), capacity)
    buckets = docs.sparkSession.createDataFrame([(x, -(-n // RANKED)) for x, n in counts.items()], "length long, buckets long")
    pieces = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.col("dealt") % F.col("buckets"))  # at most `capacity` rows
    sizes = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))

    def place(frames):
        for pdf in frames:
            rank = pdf["rank"].to_numpy(np.int64)
            i = np.searchsorted(key, (pdf["length"].to_numpy(np.int64) << 44) + rank, side="right") - 1
            within = rank - first[i]
            pdf["sequence_id"] = sequence[i] + within // each[i]
            pdf["offset"] = at[i] + within % each[i] * pdf["length"]
            yield pdf.drop(columns="rank")

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("in_bucket", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"])
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = ranked.select(*kept, (F.col("before") + F.col("in_bucket")).alias("rank"))
    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", sequence_id long, offset long"
    return ranked.mapInPandas(place, schema)
