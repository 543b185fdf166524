"""Point-in-time joins, and ranks of large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.staging import staged


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tie: str, values: list[str]) -> DataFrame:
    """``left`` with the values of the latest ``right`` row at or before its time; null before the first.

    Both sides are put into one sorted history per key (right rows first on equal times), where the last right row is
    carried on: one shuffle, no row explosion.  ``tie`` orders right rows of one time, the largest counts.
    """
    carried = F.struct(F.col(right_time), *[F.col(v) for v in values])
    a = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), carried.alias("_r"))
    kept = F.struct(*[F.col(c) for c in left.columns])
    b = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), kept.alias("_l"))
    both = a.unionByName(b, allowMissingColumns=True)
    history = Window.partitionBy(key).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.withColumn("_r", F.last("_r", ignorenulls=True).over(history)).where("_side = 1")
    return joined.select("_l.*", *[F.col("_r")[c].alias(c) for c in (right_time, *values)])


def next_after(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """``left`` with the values of the first ``right`` row strictly after its time; null after the last, and where key or time is null.

    As in :func:`asof_join` both sides form one sorted history per key.  It is sorted backwards, so that the right row to come is
    carried by a frame that only grows: a frame up to the history's end would be read anew for each row.  On equal times left
    rows come first, so that those right rows are not their next ones.
    """
    carried = F.struct(F.col(right_time), *[F.col(v) for v in values])
    known = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    a = known.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), carried.alias("_r"))
    kept = F.struct(*[F.col(c) for c in left.columns])
    b = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), kept.alias("_l"))
    history = Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    after = F.when(F.col("_t").isNotNull(), F.last("_r", ignorenulls=True).over(history))
    joined = a.unionByName(b, allowMissingColumns=True).withColumn("_r", after).where("_side = 1")
    return joined.select("_l.*", *[F.col("_r")[c].alias(c) for c in (right_time, *values)])


_ROW_BITS = 33  # of monotonically_increasing_id: the rest is the partition


def _placed(df: DataFrame, key: str | None, order: list) -> DataFrame:
    """``df`` in total order by key and ``order``: each row's range as ``_part`` and its place in it as ``_no``.

    It is written, so ranges and places are fixed from here on, whatever is lost and run again later.
    """
    by = [*([key] if key else []), *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return staged(ranged.select(*df.columns, F.shiftright("_at", _ROW_BITS).alias("_part"), F.col("_at").bitwiseAND(2**_ROW_BITS - 1).alias("_no")))


def _with_offsets(placed: DataFrame, offsets: DataFrame, key: str | None) -> DataFrame:
    """Ranges' offsets (a row for each range and the keys that begin in it) beside their rows; null keys meet, too."""
    if key is None:
        return placed.join(F.broadcast(offsets), "_part")  # one row for each range: as many as shuffle partitions
    other = offsets.withColumnsRenamed({"_part": "_opart", key: "_okey"})
    return placed.join(other, (F.col("_part") == F.col("_opart")) & F.col(key).eqNullSafe(F.col("_okey"))).drop("_opart", "_okey")


def global_ordinal(df: DataFrame, key: str | None, order: list[str | Column], out: str) -> DataFrame:
    """Ordinal rank within ``key`` (over all rows for None) by ``order``, without sorting a key in one task.

    Rows are sorted by ranges of key and order, so a key of any size and a value of any number of ties spread over ranges as
    long as ``order`` tells rows apart.  A row's rank is its place in its range, plus what lies before.
    """
    placed = _placed(df, key, order)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.select("_part", before.alias("_before"))
    if key is None:
        offsets = parts.withColumn("_first", F.lit(0))
    else:
        firsts = placed.groupBy("_part", key).agg(F.min("_no").alias("_no")).join(F.broadcast(parts), "_part")
        offsets = firsts.withColumn("_first", F.min(F.col("_before") + F.col("_no")).over(Window.partitionBy(key))).drop("_no")
    rank = F.col("_before") + F.col("_no") - F.col("_first") + 1
    return _with_offsets(placed, offsets, key).select(*df.columns, rank.alias(out))


def running_before(df: DataFrame, key: str | None, order: list[str | Column], amount: str, out: str) -> DataFrame:
    """Sum of ``amount`` over the rows of ``key`` that stand before in ``order`` (0 for the first), by ranges as in :func:`global_ordinal`."""
    placed = _placed(df, key, order)
    keys = [key] if key else []
    line = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part", *keys).agg(F.sum(amount).alias("_n"))
    offsets = totals.select("_part", *keys, F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", *keys).orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return _with_offsets(placed.withColumn("_here", here), offsets, key).select(*df.columns, (F.col("_before") + F.col("_here")).alias(out))


def shared_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the rank of ``value`` over all rows, equal values sharing the least: values are counted first, and only distinct ones are ordered."""
    counts = df.groupBy(value).agg(F.count("*").alias("_count"))
    before = running_before(counts, None, [value], "_count", "_less").select(F.col(value).alias("_value"), (F.col("_less") + 1).alias(out))
    return df.join(before, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
