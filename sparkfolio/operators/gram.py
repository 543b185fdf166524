"""Sums over all pairs of many series, by blocked Gram matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Series of a block, and days of a chunk: a cell is a dense matrix of so many numbers at most.
SERIES, DAYS = 256, 1024
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _members(x: DataFrame, size: int) -> DataFrame:
    """block, k, name, mean of each series: blocks by the name's hash, k its place by name in the block."""
    names = x.groupBy("name").agg(F.avg("value").alias("mean"))
    blocks = max(1, -(-names.count() // size))  # one number
    named = names.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int"))
    listed = named.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("name", "mean"))).alias("all"))  # about `size` names
    return listed.select("block", F.size("all").alias("width"), F.posexplode("all").alias("k", "m")).select("block", "width", "k", "m.name", "m.mean")


def _cells(x: DataFrame, members: DataFrame, days: int) -> DataFrame:
    """chunk, block, width and the cell's entries: arrays of day, k and the value less the series' mean."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    e = x.join(members, "name").select(F.floor(day / days).cast("int").alias("chunk"), "block", "width", F.struct(F.pmod(day, F.lit(days)).cast("int").alias("t"), "k", (F.col("value") - F.col("mean")).alias("v")).alias("e"))
    cells = e.groupBy("chunk", "block").agg(F.first("width").alias("width"), F.collect_list("e").alias("e"))
    return cells.select("chunk", "block", "width", F.col("e.t").alias("t"), F.col("e.k").alias("k"), F.col("e.v").alias("v"))


def _matrices(days: int):
    def matrix(cell: dict) -> tuple[np.ndarray, np.ndarray]:
        """Values with zero for what is missing, and what is there."""
        values, there = np.zeros((days, cell["width"])), np.zeros((days, cell["width"]))
        at = (np.asarray(cell["t"]), np.asarray(cell["k"]))
        values[at], there[at] = cell["v"], 1.0
        return values, there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = (batch.column(c) for c in ("i", "j"))
            for row in range(batch.num_rows):
                left, right = ({c: _flat(batch, f"{side}{c}", row) for c in ("t", "k", "v")} | {"width": batch.column(f"{side}width")[row].as_py()} for side in "xy")
                (x, mx), (y, my) = matrix(left), matrix(right)
                sums = [mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y]
                a, b = np.nonzero(sums[0])
                columns = [np.full(len(a), i[row].as_py(), "i4"), np.full(len(a), j[row].as_py(), "i4"), a.astype("i4"), b.astype("i4"), *[s[a, b] for s in sums]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "ka", "kb", *SUMS])

    return run


def _flat(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy(zero_copy_only=False)


def pair_sums(x: DataFrame, y: DataFrame | None = None, *, size: int = SERIES, days: int = DAYS) -> DataFrame:
    """a, b and the sums n, sx, sy, sxx, syy, sxy over the dates that both series have, each series less its own mean.

    ``x`` and ``y`` are series (name, date, value; a name and date at most once); nulls are missing.  With ``y`` all pairs
    of one of ``x`` and one of ``y``; without it those of two of ``x``, a before b.  Pairs without a common date are left out.

    Series are dealt to blocks and dates to chunks; blocks of one chunk meet in pairs and give their Gram matrices, which are
    added up over the chunks.  So a value is sent to as many tasks as there are blocks, not series, and no task holds more than
    two cells.  Sums less the mean give the same covariances without losing places.
    """
    x = x.where("value is not null").select("name", "date", F.col("value").cast("double").alias("value"))
    one = y is None
    y = x if one else y.where("value is not null").select("name", "date", F.col("value").cast("double").alias("value"))
    xm = _members(x, size)
    ym = xm if one else _members(y, size)
    xc = _cells(x, xm, days)
    yc = xc if one else _cells(y, ym, days)
    side = lambda c, s, block: c.select("chunk", F.col("block").alias(block), *[F.col(n).alias(f"{s}{n}") for n in ("width", "t", "k", "v")])
    both = side(xc, "x", "i").join(side(yc, "y", "j"), "chunk")  # blocks meet in pairs
    if one:
        both = both.where("i <= j")
    parts = both.repartition("chunk", "i", "j").mapInArrow(_matrices(days), "i int, j int, ka int, kb int, " + ", ".join(f"{s} double" for s in SUMS))
    if one:
        parts = parts.where("i < j or ka < kb")
    sums = parts.groupBy("i", "j", "ka", "kb").agg(*[F.sum(s).alias(s) for s in SUMS])
    left = xm.select(F.col("block").alias("i"), F.col("k").alias("ka"), F.col("name").alias("a"))
    right = ym.select(F.col("block").alias("j"), F.col("k").alias("kb"), F.col("name").alias("b"))
    named = sums.join(left, ["i", "ka"]).join(right, ["j", "kb"])
    turned = F.col("a") > F.col("b") if one else F.lit(False)
    pick = lambda p, q, to: F.when(turned, F.col(q)).otherwise(F.col(p)).alias(to)
    return named.select(
        pick("a", "b", "a"), pick("b", "a", "b"), F.col("n").cast("long").alias("n"),
        pick("sx", "sy", "sx"), pick("sy", "sx", "sy"), pick("sxx", "syy", "sxx"), pick("syy", "sxx", "syy"), "sxy",
    )


def covariance() -> Column:
    """Population covariance from the sums."""
    return F.col("sxy") / F.col("n") - F.col("sx") / F.col("n") * (F.col("sy") / F.col("n"))


def variance(of: str) -> Column:
    """Population variance of ``x`` or ``y`` from the sums, no less than zero."""
    return F.greatest(F.col(f"s{of}{of}") / F.col("n") - F.pow(F.col(f"s{of}") / F.col("n"), 2), F.lit(0.0))


def correlation() -> Column:
    """Pearson's from the sums, null where either side does not vary."""
    spread = F.sqrt(variance("x")) * F.sqrt(variance("y"))
    return F.when(spread > 1e-12, covariance() / spread)
