"""Embedding near-duplicates by E8 lattice hashing.

Unit vectors are projected to eight dimensions once per table and decoded to the nearest point of the E8 lattice; that
point is the vector's home cell, and the lattice's neighbours of it that lie nearest are probed as well.  Two vectors
are candidates if the home of one is the home or a probe of the other; candidates are verified by cosine in double
precision.  Cells are dealt out in blocks, and a task reports sums and spanning links, never the pairs themselves.

The lattice is as coarse as the projected distance of a pair at the threshold wants it: a random subspace of 8 of ``dim``
dimensions keeps sqrt(8 / dim) of a distance, so cells shrink with the dimension and hold the same share of links, and of
random pairs, at each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import staged, unstage
from sparkfolio.llm.graph import Forest, components

MIN_COSINE = 0.98
TABLES, PROBES, SEED = 6, 2, 8
#: Unit of the lattice, in projected distances of a pair at the threshold.
SCALE = 1.9
#: Members of a cell that are compared as one block.
BLOCK = 1024


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, from their rule: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    pairs = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for row, (i, j, a, b) in zip(whole, pairs, strict=True):
        row[i], row[j] = a, b
    half = np.array([s for s in itertools.product((0.5, -0.5), repeat=8) if np.prod(s) > 0])
    return np.vstack([whole, half])


SHORTEST = _shortest()


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where the sum is odd, the coordinate farthest from its integer goes to the other side."""
    point = np.rint(y)
    off = y - point
    rows, worst = np.arange(len(y)), np.abs(off).argmax(axis=1)
    odd = point.sum(axis=1) % 2 != 0
    point[rows[odd], worst[odd]] += np.where(off[rows[odd], worst[odd]] >= 0, 1, -1)
    return point


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


class Tables:
    """Projections of all tables for vectors of one dimension; ``unit`` is the lattice's unit where nothing is projected away."""

    def __init__(self, dim: int, tables: int, probes: int, unit: float, seed: int):
        self.probes, self.tables, self.dim = probes, tables, dim
        draw = np.random.default_rng([seed, dim])
        unit *= np.sqrt(8 / max(dim, 8))
        self.maps = [np.linalg.qr(draw.standard_normal((max(dim, 8), 8)))[0][:dim] / unit for _ in range(tables)]
        self.shifts = draw.random((tables, 8))
        self.odd = draw.integers(1, 2**62, size=8, dtype=np.int64) | 1

    def _key(self, point: np.ndarray, table: int, label: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (np.rint(2 * point).astype(np.int64) * self.odd).sum(axis=1) + (label * self.tables + table + 1) * np.int64(0x1E3779B97F4A7C15) + self.dim
            x = (x ^ (x >> 30)) * np.int64(0x3F58476D1CE4E5B9)
        return x ^ (x >> 29)

    def cells(self, unit: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Cell keys, [table, 0 for home or 1.. for probes, vector]."""
        out = np.empty((self.tables, 1 + self.probes, len(unit)), dtype=np.int64)
        for t in range(self.tables):
            y = unit @ self.maps[t] + self.shifts[t]
            home = nearest_e8(y)
            out[t, 0] = self._key(home, t, label)
            if self.probes:
                near = np.argsort(-((y - home) @ SHORTEST.T), axis=1, kind="stable")[:, : self.probes]
                for p in range(self.probes):
                    out[t, p + 1] = self._key(home + SHORTEST[near[:, p]], t, label)
        return out


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of an array of lists, null ones as NaN, and where each list begins and ends among them."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of one length as rows of norm 1, in double precision."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares of huge and tiny components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, digest of the vector (null if it can't be linked) and the vector, of the input's own precision."""
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = "float" if single else "double"  # single numbers are half as long to send and lose nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            numbers, at = _flat(batch.column(2))
            numbers = numbers.astype(np.float64) + 0.0  # one zero
            keys = []
            for label, lo, hi in zip(batch.column(1).to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                x = numbers[lo:hi]
                ok = label is not None and np.isfinite(x).all() and x.any()
                keys.append(blake2b(x.tobytes(), digest_size=16).digest() if ok else None)
            keys = pa.array(keys, pa.binary())
            vectors = pc.if_else(keys.is_valid(), batch.column(2), pa.scalar(None, batch.column(2).type))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, vectors], ["vec_id", "label", "digest", "v"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(run, f"vec_id long, label long, digest binary, v array<{kind}>")


def _hashed(nodes: DataFrame, make: tuple) -> DataFrame:
    """Rows (cell, at home or not, table) of each node, without the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Tables] = {}
        for batch in batches:
            node, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            numbers, starts = _flat(batch.column(2))
            length = np.diff(starts)
            for dim in np.unique(length):
                at = np.flatnonzero(length == dim)
                if dim not in tables:
                    tables[dim] = Tables(int(dim), *make)
                cells = tables[dim].cells(_units(numbers[starts[at][:, None] + np.arange(dim)]), label[at])
                n_tables, per, n = cells.shape
                table, probe = np.repeat(np.arange(n_tables), per * n), np.tile(np.repeat(np.arange(per), n), n_tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(node[at], n_tables * per)), pa.array(cells.ravel()), pa.array(table, pa.int32()), pa.array(probe == 0)], ["node", "cell", "t", "home"]
                )

    return nodes.select("node", "label", "v").mapInArrow(run, "node long, cell long, t int, home boolean")


def _linked(dealt: DataFrame, make: tuple, least: float) -> DataFrame:
    """For each node of a block: how many vectors it is linked with there, and the smallest node it hangs on there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Tables] = {}
        carry = None
        for batch in itertools.chain(batches, [None]):
            frame = carry if batch is None else pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
            if frame is None or not frame.num_rows:
                continue
            cell, i, j, dim = (frame.column(c).to_numpy() for c in ("cell", "i", "j", "dim"))  # keys of different lengths can clash
            new = np.flatnonzero((cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (dim[1:] != dim[:-1])) + 1
            done = frame.num_rows if batch is None else int(new[-1]) if len(new) else 0
            carry = frame.slice(done) if batch is not None else None
            if done:
                yield _groups(frame.slice(0, done), np.concatenate(([0], new[new < done], [done])), tables, make, least)

    return dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "dim").mapInArrow(run, "node long, links long, root long")


def _groups(frame: pa.Table, ends: np.ndarray, tables: dict, make: tuple, least: float) -> pa.RecordBatch:
    node, label, mult, block, home = (frame.column(c).to_numpy() for c in ("node", "label", "mult", "block", "home"))
    t, i, j = (frame.column(c).to_numpy() for c in ("t", "i", "j"))
    vectors = frame.column("v").combine_chunks()
    starts, values = vectors.offsets.to_numpy(), vectors.values.to_numpy()
    out: list[tuple] = []
    for lo, hi in itertools.pairwise(ends.tolist()):
        dim = int(starts[lo + 1] - starts[lo])
        if hi - lo < 2 or not home[lo:hi].any():
            continue
        unit = _units(values[starts[lo] : starts[hi]].reshape(hi - lo, dim))
        close = unit @ unit.T >= least
        at, own = slice(lo, hi), home[lo:hi]
        close &= own[:, None] | own[None, :]
        if i[lo] != j[lo]:
            close &= block[at][:, None] < block[at][None, :]
        else:
            close = np.triu(close, 1)
        a, b = np.nonzero(close)
        if not len(a):
            continue
        ids, names = node[at], label[at]
        ok = (ids[a] != ids[b]) & (names[a] == names[b])
        a, b = a[ok], b[ok]
        a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
        if dim not in tables:
            tables[dim] = Tables(dim, *make)
        if len(a):
            first = ~_earlier(tables[dim].cells(unit, names), a, b, int(t[lo]), own)
            a, b = a[first], b[first]
        if not len(a):
            continue
        links = np.bincount(a, mult[at][b], hi - lo) + np.bincount(b, mult[at][a], hi - lo)
        forest = Forest()
        for x, y in zip(ids[a].tolist(), ids[b].tolist(), strict=True):
            forest.join(x, y)
        out += [(int(ids[k]), int(links[k]), forest.root(int(ids[k]))) for k in np.flatnonzero(links)]
    columns = list(zip(*out, strict=True)) if out else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "root"])


def _earlier(cells: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, own: np.ndarray) -> np.ndarray:
    """Whether a pair (a the smaller) meets in a table before, or in this one first in the cell of a: each pair counts once."""
    seen = np.zeros(len(a), dtype=bool)
    for t in range(table):
        homes, probes = cells[t, 0], cells[t, 1:]
        seen |= (homes[a] == homes[b]) | (homes[a] == probes[:, b]).any(axis=0) | (homes[b] == probes[:, a]).any(axis=0)
    at_b = own[b] & ~own[a]
    return seen | (at_b & (cells[table, 0][a] == cells[table, 1:][:, b]).any(axis=0))


def near_duplicate_vectors(
    vectors: DataFrame, *, min_cosine: float = MIN_COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows of one label are linked where their cosine is at least ``min_cosine``.  ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest vec_id reachable, ``kept`` says that it is the row's own.

    * Null labels and vectors that are null, empty, zero, or hold null or non-finite components link with nothing and
      stay.  Vectors of different lengths are not linked.
    * Equal vectors of a label (repeated rows too) are one class: they are linked by definition and hashed once.
    * A null vec_id links with nothing; its component is null and it stays.  Other columns are ignored.
    * Pairs at the threshold are found with a probability (recall) of 0.99 and more in 4 to 1536 dimensions, which the
      tests measure, as they do the share of random pairs that are looked at (under 1 % from 8 dimensions on).
    """
    make = (tables, probes, scale * (2 - 2 * min_cosine) ** 0.5, seed)
    keyed = staged(_keyed(vectors))
    usable = keyed.where("digest is not null and vec_id is not null")
    classes = staged(usable.groupBy("label", "digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult")))
    nodes = staged(
        usable.join(classes.select(F.col("digest").alias("d"), F.col("label").alias("l"), "node", "mult"), (F.col("vec_id") == F.col("node")) & (F.col("digest") == F.col("d")) & (F.col("label") == F.col("l")))
        .dropDuplicates(["label", "digest"])
        .select("node", "label", "v", "mult")
    )
    cells = staged(_hashed(nodes, make))
    crowded = staged(cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home").drop("any_home"))
    rows = cells.join(crowded, "cell").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", "cell"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select("node", "cell", "t", "home", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")).join(nodes.withColumn("dim", F.size("v")), "node")
    found = staged(_linked(dealt.select("node", "label", "v", "mult", "cell", "t", "home", "block", "i", "j", "dim"), make, min_cosine))
    unstage(cells, crowded, nodes)
    labels = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = (
        classes.join(labels, "node", "left")
        .join(counts, "node", "left")
        .select("label", "digest", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    )
    usable_id = F.when(F.col("vec_id").isNotNull(), F.col("digest"))
    return (
        keyed.withColumn("digest", usable_id)
        .join(placed, ["label", "digest"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
        )
    )
