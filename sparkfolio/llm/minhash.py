"""Near-duplicate documents by one-permutation MinHash with optimal densification.

1. Each document's set of hashed word shingles gives one signature: the hash range is cut into bins, a bin holds the
   smallest hash in it, and an empty bin borrows from the first filled one in an order of its own (densification).
2. Documents with the same set are one class from here on.  Bands of signature rows make bucket keys; a bucket links its
   members as stars around its smallest and its largest member, so pairs stay linear in the members.
3. Pairs whose sketches (a byte of each bin) rule a link out go; links are confirmed on full sets and joined to components.
4. What stars could miss: the members of buckets that still hold more than one component are put together by their
   bucket's centre (two that share a bucket share its centre), and there those outside the largest component are
   compared with all of the others, on full sets and in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import staged, unstage
from sparkfolio.llm.graph import Forest, components

BANDS, ROWS = 32, 5
SHINGLE_WORDS, PERCENT = 5, 80
#: Hashes of one block of sets (a block of probes and one of others are in a worker's memory together).
BLOCK_HASHES = 1_500_000
#: Rounds that confirm only the most promising open pair of each document, before all that are still open.
BEST_ROUNDS = 2
CACHE_WORDS = 400_000
_WORDS: dict[bytes, int] = {}
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads each input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; a shorter text is one run; no words, no hashes.

    Words are runs without ASCII white space, A-Z in lower case.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    from xxhash import xxh3_64_intdigest

    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    get = _WORDS.get
    got = list(map(get, words))
    if None in got:
        for w in {w for w, h in zip(words, got, strict=True) if h is None}:
            _WORDS[w] = xxh3_64_intdigest(w)
        got = list(map(_WORDS.__getitem__, words))
    h = np.array(got, dtype=np.uint64)
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = _mix(out * _M1 + h[k : len(h) - n + 1 + k])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


class Signer:
    """Signatures of ``bands * rows`` bins and their bucket keys."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, k = bands, rows, bands * rows
        self.bounds = np.array([(i << 64) // k for i in range(k)], dtype=np.uint64)
        draw = np.random.default_rng(20_240_611)
        self.order = np.array([draw.permutation(k) for _ in range(k)])  # where each bin looks when it is empty
        self.band = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _M1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(hashes, self.bounds)
        value = hashes[np.minimum(at, len(hashes) - 1)]
        upper = np.append(at[1:], len(hashes))
        filled = at < upper
        empty = np.flatnonzero(~filled)
        if len(empty):
            order = self.order[empty]
            from_bin = order[np.arange(len(empty)), filled[order].argmax(axis=1)]
            value[empty] = value[from_bin]
        return value

    def keys(self, hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bucket keys, and one byte of each bin's hash."""
        signature = self.signature(hashes)
        rows = signature.reshape(self.bands, self.rows)
        key = self.band.copy()
        for r in range(self.rows):
            key = _mix(key * _M1 + rows[:, r])
        return key.view(np.int64), _mix(signature).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, th, n_shingles, set_key (128-bit digest of the set, null for none), the bucket keys and a byte of each bin."""
    list_type = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        signer = Signer(bands, rows)
        for batch in batches:
            out = []
            for text in batch.column(2):
                hashes = shingle_set(text.as_py(), size)
                full = len(hashes) > 0
                key = blake2b(hashes.tobytes(), digest_size=16).digest() if full else None
                out.append((len(hashes), key, *(signer.keys(hashes) if full else (None, None))))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            types = [pa.int64(), pa.binary(), list_type, pa.binary()]
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "th", "n_shingles", "set_key", "keys", "sketch"])

    return docs.mapInArrow(run, "doc_id long, th long, n_shingles long, set_key binary, keys array<long>, sketch binary")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """node and its set as bytes, of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    return rows.select("node", "text").mapInArrow(run, "node long, hashes binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            yield pdf.loc[keep, ["a", "b"]]

    x = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bins sketches agree."""
    return (x == y).sum(axis=-1)


def may_be_similar(agree: np.ndarray, bins: int, sizes: np.ndarray | int, percent: int) -> np.ndarray:
    """Whether sketches agree in about as many bins as a pair of the wanted similarity does, less five standard deviations.

    ``sizes`` are those of the smaller sets: a set of fewer hashes than bins has so many bins of its own only.  A byte
    agrees by chance in one bin of 256, which only lets more pairs through.  Bins agree independently with the pair's
    similarity s, so a pair at s = percent falls below the limit with a probability under 1e-6 (five deviations of a
    binomial count of at least 14 trials; the normal tail is 3e-7); pairs above it with less.
    """
    s = percent / 100
    least = s - 5 * np.sqrt(s * (1 - s) / np.minimum(sizes, bins))
    return agree >= least * bins


def _hopeful(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule a link out, and how far they agree."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), -1) for c in ("x", "y"))
                agree = agreeing(x, y)
                yield pdf.assign(agree=agree).loc[may_be_similar(agree, x.shape[1], pdf["n"].to_numpy(), percent), ["a", "b", "agree"]]

    x = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x"), F.col("n_shingles").alias("n_a"))
    y = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n_shingles").alias("n_b"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    met = pairs.join(x, "a").join(y, "b").where(100 * small >= percent * large)  # else sizes alone rule a link out
    return met.select("a", "b", "x", "y", small.alias("n")).mapInPandas(run, "a long, b long, agree long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _across(percent: int):
    """One block of probes against one block of others: confirmed links between components, no more than it takes to join them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        probes = pdf[pdf["probe"]].drop_duplicates("node")
        others = pdf[~pdf["probe"]].drop_duplicates("node")
        forest, out = Forest(), []
        if len(probes) and len(others):
            nodes, comps = others["node"].to_numpy(), others["component"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in others["hashes"]]
            sizes = np.array([len(s) for s in sets])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            values, ids = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(values), dtype=bool)
            for node, comp, held in zip(probes["node"].tolist(), probes["component"].tolist(), probes["hashes"], strict=True):
                own = np.frombuffer(held, np.uint64)
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                at = at[values[at] == own]
                mark[at] = True
                both = np.add.reduceat(mark[ids], starts, dtype=np.int64)
                mark[at] = False
                hit = (100 * both >= percent * (sizes + len(own) - both)) & (comps != comp)
                for m in np.flatnonzero(hit):
                    if forest.join(comp, int(comps[m])):
                        out.append((min(node, int(nodes[m])), max(node, int(nodes[m]))))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(
    docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id, kept, class_id.

    Two texts are linked if 100 * common shingles >= percent * all their shingles; ``component_id`` is the smallest
    doc_id reachable over links, ``kept`` says that it is the row's own, ``class_id`` is the smallest doc_id with the
    very same set.

    * Null, empty and blank texts have no set and are linked with nothing; they stay.  Null doc_ids too: their component
      is null and they stay.
    * Texts of fewer than ``shingle_words`` words are one shingle.  Rows that repeat a doc_id each get a row and follow
      their own text.  Other columns are not looked at, whatever their names.
    * A pair of similarity s shares a bucket with probability 1 - (1 - s^rows)^bands: at the default sizes all but 3 in
      a million pairs at 0.8 and 1 in 10^8 at 0.85.
    """
    return _placed(docs, shingle_words, percent, bands, rows).drop("th")


def _placed(docs: DataFrame, shingle_words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """What :func:`near_duplicates` gives, and ``th``, the hash of the row's text."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(F.col("text")).alias("th"), "text")
    sig = staged(signatures(source, shingle_words, bands, rows))
    with_set = sig.where("set_key is not null and doc_id is not null")
    # one node per distinct set, numbered once: the numbers are written before they are used; keys and sketch are the set's
    of_set = [F.first(c).alias(c) for c in ("n_shingles", "keys", "sketch")]
    first = with_set.groupBy("set_key").agg(F.min(F.struct("doc_id", "th")).alias("first"), *of_set)
    one = staged(first.select("set_key", "first.doc_id", "first.th", "n_shingles", "keys", "sketch").withColumn("node", F.monotonically_increasing_id()))
    classes = one.select("set_key", "doc_id", "th", "node")
    repeated = with_set.groupBy("doc_id", "th").count().where("count > 1").limit(1).count() > 0
    exploded = one.select("node", F.explode("keys").alias("key"))
    buckets = staged(exploded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("n > 1"))
    members = staged(exploded.join(buckets, "key").select("node", "low", "high", "n"))
    pairs = staged(_star(members, "low").union(_star(members, "high")).distinct())
    hopeful = staged(_hopeful(pairs, one.select("node", "n_shingles", "sketch"), percent))
    sets = _sets_of(source, classes, hopeful.select(F.col("a").alias("node")).union(hopeful.select("b")), shingle_words, repeated)
    links, labels = _joined(hopeful, sets, percent)
    # buckets of four and more have pairs that no star has tried; those still in several components are compared inside
    held = members.where("n > 3").select(F.col("low").alias("centre"), "node").distinct()
    held = held.join(one.select("node", "n_shingles"), "node").join(labels, "node", "left")
    held = staged(held.select("centre", "node", "n_shingles", F.coalesce("component", "node").alias("component")))
    rest = staged(_open(held))
    if rest.select("node").limit(1).count():
        more = _sets_of(source, classes, rest.select("node"), shingle_words, repeated)
        found = rest.join(more, "node").groupBy("centre", "i", "j").applyInPandas(_across(percent), "a long, b long")
        all_links = staged(links.union(staged(found.distinct())))
        labels = staged(components(all_links))
        unstage(more, all_links)
    unstage(buckets, members, pairs, hopeful, sets, links, held, rest)
    placed = classes.join(labels, "node", "left").select("set_key", F.col("doc_id").alias("class_id"), F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("class_id").alias("component_id"))
    placed = staged(placed.join(least, "component").select("set_key", "class_id", "component_id"))
    unstage(one, labels)
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept")
    out = sig.join(placed, "set_key", "left")
    return out.select("doc_id", "th", "n_shingles", own("component_id").alias("component_id"), kept, own("class_id").alias("class_id"))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def _open(held: DataFrame) -> DataFrame:
    """The members of centres with more than one component, dealt to blocks: those outside the largest as probes, and all.

    A task (centre, i, j) has the i-th block of probes and the j-th of all members; members of the largest component
    never meet each other.
    """
    parts = held.groupBy("centre", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    centres = parts.groupBy("centre").agg(
        F.max(F.struct("n", "component", "size")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("parts")
    )
    blocks = lambda size: F.ceil(size / BLOCK_HASHES).cast("int")
    centres = centres.where("parts > 1").select(
        "centre", F.col("main.component").alias("main"), blocks(F.col("size") - F.col("main.size")).alias("probe_blocks"), blocks(F.col("size")).alias("blocks")
    )
    rows = held.join(staged(centres), "centre")
    dealt = lambda n: F.pmod(F.xxhash64("node", "centre"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = rows.where("component <> main").select("centre", "node", "component", F.lit(True).alias("probe"), dealt("probe_blocks").alias("i"), every("blocks").alias("j"))
    others = rows.select("centre", "node", "component", F.lit(False).alias("probe"), dealt("blocks").alias("j"), every("probe_blocks").alias("i"))
    return probes.unionByName(others)


def _joined(pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links that connect all that the pairs' true links connect, and their components.

    Sets are sent only for pairs that could still join two components: first for each node's most promising one,
    as most are joined by it, and in the end for all that are open.
    """
    links = labels = None
    for k in range(BEST_ROUNDS + 1):
        now = pairs
        if k < BEST_ROUNDS:
            pair = F.struct("agree", "a", "b")
            ends = pairs.select(F.col("a").alias("node"), pair.alias("p")).union(pairs.select("b", pair))
            now = ends.groupBy("node").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct()
        now = staged(now.select("a", "b"))
        found = _confirmed(now, sets, percent)
        links = staged(found if links is None else links.union(found))
        labels = staged(components(links))
        if k < BEST_ROUNDS:
            x = labels.select(F.col("node").alias("a"), F.col("component").alias("c"))
            y = labels.select(F.col("node").alias("b"), F.col("component").alias("d"))
            untried = pairs.join(now, ["a", "b"], "left_anti")
            pairs = staged(untried.join(x, "a", "left").join(y, "b", "left").where("c is null or d is null or c <> d").select("a", "b", "agree"))
    return links, labels


def _star(members: DataFrame, centre: str) -> DataFrame:
    """Pairs (a < b) of the members and their bucket's centre."""
    return members.where(F.col("node") != F.col(centre)).select(F.least("node", centre).alias("a"), F.greatest("node", centre).alias("b"))


def _sets_of(source: DataFrame, classes: DataFrame, nodes: DataFrame, size: int, repeated: bool) -> DataFrame:
    """Sets of these nodes, made anew from the text of one row each; ``repeated`` tells that rows may be there twice."""
    wanted = classes.join(nodes.distinct(), "node").select("node", "doc_id", "th")
    sets = _sets(source.join(wanted, ["doc_id", "th"]), size)
    return staged(sets.dropDuplicates(["node"]) if repeated else sets)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns.

    Of rows that repeat a doc_id within one component, only those of its smallest text hash stay, and of rows with the
    same doc_id and text one.
    """
    sizes = {"shingle_words": SHINGLE_WORDS, "percent": PERCENT, "bands": BANDS, "rows": ROWS} | options
    placed = _placed(docs, **sizes).where("n_shingles > 0 and doc_id is not null")
    stay = placed.where("kept").groupBy("doc_id", "component_id").agg(F.min("th").alias("first"), F.count("*").alias("n"))
    named = lambda df, hashed: df.select(F.col("doc_id").alias("d"), F.col(hashed).alias("h"))
    gone = staged(named(placed.join(stay.drop("n"), ["doc_id", "component_id"], "left").where("first is null or first <> th"), "th").distinct())
    twice = staged(named(stay.where("n > 1"), "first"))
    doc_id, text_hash = docs["doc_id"].cast("long"), _text_hash(docs["text"])
    met = lambda marks: (doc_id == marks["d"]) & (text_hash == marks["h"])
    out = docs.join(gone, met(gone), "left_anti")
    if twice.limit(1).count():
        again = out.join(twice, met(twice), "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(twice, met(twice), "left_anti").union(again)
    return out
