"""Stationary block bootstrap with resamples dealt to tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Resamples that a task's row makes at a time.
TOGETHER = 50


def resampled(values: np.ndarray, number: int, seed: int, block: int) -> np.ndarray:
    """Resample ``number`` of a series: blocks of geometric length from uniform starts, wrapped around its end.

    Its random numbers come from a counter-based generator keyed by the seed and the number, so they are the same wherever
    and with whatever others it is made.
    """
    n = len(values)
    draw = np.random.Generator(np.random.Philox(key=np.array([seed, number], dtype=np.uint64)))
    starts, fresh = draw.integers(0, n, size=n), draw.random(n) < 1 / max(block, 1)
    fresh[0] = True
    steps = np.arange(n)
    last = np.maximum.accumulate(np.where(fresh, steps, 0))
    return values[(starts[last] + steps - last) % n]


def intervals(
    series: DataFrame, key: str, order: str, metrics: Mapping[str, tuple[str, Callable[[np.ndarray], float]]], *, draws: int = 1000, block: int = 20, seed: int = 42, level: float = 0.95, together: int = TOGETHER
) -> DataFrame:
    """``key`` and, for each metric (a column and a function of a series), name_low and name_high of its bootstrap.

    A key's series goes to as many tasks as ``draws`` take at ``together`` each, as a row of arrays; what comes back is one
    number a resample, whose quantiles are the interval.  Nulls and NaN leave a series; under five values or five numbers
    give nulls.  A series is as long as its dates.
    """
    columns = sorted({c for c, _ in metrics.values()})
    listed = series.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *[F.col(c).cast("double").alias(c) for c in columns]))).alias("s"))
    arrays = listed.select(key, *[F.filter(F.col(f"s.{c}"), lambda v: v.isNotNull() & ~F.isnan(v)).alias(c) for c in columns])
    chunks = arrays.select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // together) - 1))).alias("chunk")).repartition(key, "chunk")
    kind = dict(series.dtypes)[key]
    names = list(metrics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(c) for c in columns}
            for row, chunk in enumerate(batch.column("chunk").to_pylist()):
                numbers = range(chunk * together, min(draws, (chunk + 1) * together))
                found = []
                for c, metric in metrics.values():
                    x = at[c][row].values.to_numpy(zero_copy_only=False)
                    found.append([float(metric(resampled(x, k, seed, block))) if len(x) >= 5 else None for k in numbers])
                keys = pa.array([batch.column(0)[row].as_py()] * len(numbers), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(f, pa.float64()) for f in found]], [key, *names])

    got = chunks.mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))
    number = lambda n: F.when(~F.isnan(n), F.col(n))
    edge = lambda n, q: F.when(F.count(number(n)) >= 5, F.percentile(number(n), F.lit(q)))
    tail = (1 - level) / 2
    return got.groupBy(key).agg(*[edge(n, q).alias(f"{n}_{side}") for n in names for side, q in (("low", tail), ("high", 1 - tail))])
