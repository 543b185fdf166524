"""Streams of stories, moods, bars, reactions, cards and alerts, with state that a watermark bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkfolio.functions.shipping import ship_package
from sparkfolio.functions.staging import new_folder, staged, stored
from sparkfolio.sources.feeds import story_hash


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of files."""
    ship_package(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def alert_buckets(events: DataFrame, late: str = "1 day") -> DataFrame:
    """One alert per ticker, type and half hour, once only within the watermark."""
    bucket = F.window("ts", "30 minutes")["start"]
    keyed = events.select(F.col("user_id").alias("ticker"), F.col("event_type").alias("type"), bucket.alias("bucket"), "ts")
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["ticker", "type", "bucket"]).drop("ts")


def fresh_stories(events: DataFrame, documents: DataFrame, late: str = "1 day") -> DataFrame:
    """Stories of the stream by their hash, each once within the watermark; headlines come from the static documents."""
    d = documents.select("doc_id", F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("headline"))
    url = F.concat(F.lit("HTTPS://News.Example.COM/Story/"), F.col("event_id") % 100, F.lit("?utm="), F.col("event_id"))
    stories = events.where("ts is not null").join(d, F.col("event_id") == F.col("doc_id")).select(story_hash(F.concat(F.lit("t"), F.col("user_id")), url, F.col("headline")).alias("hash"), F.col("ts").alias("published_at"))
    return stories.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["hash"]).select("hash")


def trailing_mood(events: DataFrame, length: str = "24 hours", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Trailing mean and count of values per ticker, refreshed each slice (rows are updated until the watermark passes).

    An event is in as many windows of the state as ``length`` has slides: this is for increments.  A backlog goes through
    :func:`mood_slices` and :func:`moods_of_slices`.
    """
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"), F.col("user_id").alias("ticker"))
    return grouped.agg(F.avg("value").alias("mean"), F.count("*").alias("n")).select(F.col("w.end").alias("at"), "ticker", "mean", "n")


#: The slice of :func:`trailing_mood`'s defaults, and how many of them a mood looks back on.
SLICE_S, SLICES = 900, 96


def mood_slices(events: DataFrame) -> DataFrame:
    """ticker, slice, sum, known and n of the stream's values by quarters of an hour, of all that is there now.

    Sums and counts add up over batches, so no batch needs the ones before it: each writes its own under its number, and again
    there when it is repeated.  There is no state to bound, and late events count, however late.
    """
    spark = events.sparkSession
    at = new_folder(spark, "stream")
    part = events.where("ts is not null").select(F.col("user_id").alias("ticker"), F.floor(F.unix_timestamp("ts") / SLICE_S).alias("slice"), "value")

    def put(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("ticker", "slice").agg(F.sum("value").alias("sum"), F.count("value").alias("known"), F.count("*").alias("n"))
        sums.write.mode("overwrite").parquet(f"{at}/data/part={number}")

    part.writeStream.option("checkpointLocation", f"{at}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    kinds = dict(part.dtypes)
    data = spark.read.schema(f"ticker {kinds['ticker']}, slice long, sum double, known long, n long").parquet(f"{at}/data")
    return data.groupBy("ticker", "slice").agg(*[F.sum(c).alias(c) for c in ("sum", "known", "n")])


def moods_of_slices(slices: DataFrame, length: int = SLICES) -> DataFrame:
    """at, ticker, mean and n of the last ``length`` slices, for each slice's end that has any of them.

    A mood changes where a slice comes in and where one goes out.  So a ticker's history has two rows for each slice, each
    with the sum of the slices it looks back on, and a row's mood is given out for all ends up to the next change.
    """
    comes = slices.select("ticker", (F.col("slice") + 1).alias("end"), "sum", "known", "n")
    zero = F.lit(0).cast("long")
    goes = slices.select("ticker", (F.col("slice") + 1 + length).alias("end"), F.lit(None).cast("double").alias("sum"), zero.alias("known"), zero.alias("n"))
    own = Window.partitionBy("ticker").orderBy("end")
    back = own.rangeBetween(-(length - 1), 0)
    changes = comes.unionByName(goes).select("ticker", "end", F.lead("end").over(own).alias("next"), *[F.sum(c).over(back).alias(c) for c in ("sum", "known", "n")])
    held = changes.where("n > 0 and next > end")  # of changes at one end the last one tells
    ends = held.select("ticker", F.explode(F.sequence("end", F.col("next") - 1)).alias("end"), F.try_divide("sum", "known").alias("mean"), "n")
    return ends.select(F.timestamp_seconds(F.col("end") * SLICE_S).alias("at"), "ticker", "mean", "n")


def reactions(events: DataFrame, bars: DataFrame, span: str = "60 minutes", late: str = "2 hours") -> DataFrame:
    """Events of a stream beside the bars of another within a span after them: an interval join whose state both watermarks bound."""
    e = events.select(F.col("event_id"), F.col("user_id").alias("ticker"), F.col("ts").alias("event_at")).withWatermark("event_at", late)
    b = bars.select(F.col("user_id").alias("bar_ticker"), F.col("ts").alias("bar_at"), F.col("event_id").alias("bar_id"), F.col("value").alias("close")).withWatermark("bar_at", late)
    near = F.expr(f"ticker = bar_ticker and bar_at >= event_at and bar_at <= event_at + interval {span}")
    return e.join(b, near).select("event_id", "bar_at", "bar_id", "close")


def latest_bars(events: DataFrame, path: str) -> None:
    """Minute bars of the stream kept as one row per ticker and minute, the latest wins: each batch rewrites only the days it touches."""
    spark = events.sparkSession
    schema = "ticker long, minute timestamp, close double, at timestamp, id long, day date"
    newest = F.struct("at", "id")

    def merge(batch: DataFrame, number: int) -> None:
        bars = batch.select(F.col("user_id").alias("ticker"), F.date_trunc("minute", "ts").alias("minute"), F.col("value").alias("close"), F.col("ts").alias("at"), F.col("event_id").alias("id")).where("minute is not null")
        new = bars.withColumn("day", F.to_date("minute"))
        if stored(spark, path):
            old = spark.read.schema(schema).parquet(path).join(new.select("day").distinct(), "day", "left_semi")
            new = new.unionByName(old)
        one = new.groupBy("ticker", "minute", "day").agg(F.max_by(F.struct("close", "at", "id"), newest).alias("b")).select("ticker", "minute", "b.*", "day")
        staged(one).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    events.writeStream.option("checkpointLocation", f"{path}-state").foreachBatch(merge).trigger(availableNow=True).start().awaitTermination()


class CardRater(StatefulProcessor):
    """Rates the cards of one ticker and day; the tier held is its state, and a timer in event time ends it.

    A batch's cards are taken in the order of (ts, event_id).  The timer stands ``kept`` after the day's end, once for each day, so
    state goes when the watermark has left the day behind, whether or not another card comes.
    """

    def __init__(self, rate: Callable[[list, str | None], list[str]], kept_ms: int = 86_400_000):
        self.rate, self.kept_ms = rate, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "tier string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.held.get()[0] if self.held.exists() else None
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        tiers = self.rate(pdf["score"].tolist(), held)
        if held is None:
            end = int(pd.Timestamp(key[1]).timestamp() * 1000) + 86_400_000
            self.handle.registerTimer(max(end + self.kept_ms, timerValues.getCurrentWatermarkInMs() + 1))
        self.held.update((tiers[-1],))
        before = [held, *tiers[:-1]]
        yield pd.DataFrame({"ticker": key[0], "event_id": pdf["event_id"], "tier": tiers, "alert": [b is not None and b != t for b, t in zip(before, tiers, strict=True)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        yield pd.DataFrame({"ticker": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "tier": pd.Series(dtype="object"), "alert": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def rated_cards(cards: DataFrame, rate: Callable[[list, str | None], list[str]], late: str = "1 day") -> DataFrame:
    """Cards (ticker, event_id, ts, score) with their tier and whether it differs from the card before it of the same day.

    ``rate`` gives the tiers of scores in order after a held one.  The stream needs the state store of :func:`with_state`.
    Each ticker and day is a call into Python, so this is for increments; a backlog goes through :func:`rated_cards_by_batch`.
    """
    keyed = cards.withWatermark("ts", late).withColumn("day", F.to_date("ts")).groupBy("ticker", "day")
    return keyed.transformWithStateInPandas(CardRater(rate), "ticker long, event_id long, tier string, alert boolean", "Append", "EventTime")


def _rated(rate: Callable[[list, str | None], list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tiers of rows that come by key and in order: ``first`` tells a key's first row, which starts from the tier held before the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # the tier of the row before, which may be of another batch of rows
        for batch in batches:
            scores, first, held = (batch.column(c).to_pylist() for c in ("score", "first", "held"))
            starts = [k for k, new in enumerate(first) if new]
            tiers, alerts = [], []
            for a, z in zip([0, *starts], [*starts, len(scores)], strict=True):
                if a == z:
                    continue
                before = held[a] if first[a] else now
                got = rate(scores[a:z], before)
                alerts += [b is not None and b != t for b, t in zip([before, *got[:-1]], got, strict=True)]
                tiers += got
                now = got[-1]
            kept = [batch.column(c) for c in ("ticker", "event_id")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(tiers, pa.string()), pa.array(alerts, pa.bool_()), batch.column("day"), batch.column("last")], ["ticker", "event_id", "tier", "alert", "day", "last"])

    return run


def rated_cards_by_batch(cards: DataFrame, rate: Callable[[list, str | None], list[str]], kept: int = 3, at: str | None = None) -> DataFrame:
    """What :func:`rated_cards` gives, of all that is there now, for batches of any size: a batch's cards pass by in one sorted run.

    The tier held at the end of a ticker's day is a row of the batch's own table, which the next batch joins; days more than ``kept``
    before the newest one leave it.  Cards and tiers lie under the batch's number, so a batch that is repeated replaces them.  With
    ``at``, a folder of the caller, it goes on where the last one that wrote there ended.
    """
    spark = cards.sparkSession
    at = at or new_folder(spark, "stream")
    held_schema = "ticker long, day date, tier string"
    own = Window.partitionBy("ticker", "day").orderBy("ts", "event_id")

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select("ticker", "event_id", "ts", "score", F.to_date("ts").alias("day"))
        old = spark.read.schema(held_schema).parquet(f"{at}/held/part={number - 1}") if number else spark.createDataFrame([], held_schema)
        rows = rows.withColumn("first", F.row_number().over(own) == 1).withColumn("last", F.lead(F.lit(1)).over(own).isNull())
        if number:
            o = old.toDF("_ticker", "_day", "held")
            rows = rows.join(o, F.col("ticker").eqNullSafe(F.col("_ticker")) & (F.col("day") == F.col("_day")), "left").drop("_ticker", "_day")
            rows = rows.repartition("ticker", "day").sortWithinPartitions("ticker", "day", "ts", "event_id", F.desc("first"), "last")
        else:
            rows = rows.withColumn("held", F.lit(None).cast("string"))  # the windows have dealt and sorted the rows
        out = rows.select("ticker", "event_id", "score", "first", "held", "day", "last").mapInArrow(_rated(rate), "ticker long, event_id long, tier string, alert boolean, day date, last boolean")
        out.write.mode("overwrite").parquet(f"{at}/data/part={number}")
        new = spark.read.schema(out.schema).parquet(f"{at}/data/part={number}").where("last").select("ticker", "day", "tier", F.lit(1).alias("no"))
        both = new.unionByName(old.withColumn("no", F.lit(0)))
        newest = both.agg(F.max("day")).first()[0]
        held = both.where(F.lit(newest is None) | (F.col("day") > F.date_sub(F.lit(newest), kept))).groupBy("ticker", "day").agg(F.max_by("tier", "no").alias("tier"))
        held.write.mode("overwrite").parquet(f"{at}/held/part={number}")

    cards.writeStream.option("checkpointLocation", f"{at}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("ticker long, event_id long, tier string, alert boolean, day date, last boolean").parquet(f"{at}/data").select("ticker", "event_id", "tier", "alert")


#: The state store that keeps typed state variables and timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_state(spark: SparkSession) -> Iterator[None]:
    """Streams started here keep their state in the store for state variables; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hysteresis_tiers(events: DataFrame, band: float = 10.0, cut: float = 50.0) -> DataFrame:
    """A tier per ticker that changes only when its value leaves the cut by more than the band; the tier held is the state.

    A batch's values are taken in the order of (ts, event_id), each ticker's in one frame: this is for increments of
    bounded batches.  A backlog goes through :func:`hysteresis_tiers_of_table`.
    """

    def run(key, frames, state):
        held = state.get[0] if state.exists else None
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event, v in zip(pdf["event_id"], pdf["value"], strict=True):
            now = "HIGH" if v > cut else "LOW"
            if held is None or (now != held and abs(v - cut) > band):
                held = now
            out.append((key[0], event, held))
        state.update((held,))
        yield pd.DataFrame(out, columns=["ticker", "event_id", "tier"])

    keyed = events.where("value is not null").select(F.col("user_id").alias("ticker"), "event_id", "ts", "value")
    kind = dict(keyed.dtypes)
    return keyed.groupBy("ticker").applyInPandasWithState(run, f"ticker {kind['ticker']}, event_id {kind['event_id']}, tier string", "tier string", "append", "NoTimeout")


def hysteresis_tiers_of_table(events: DataFrame, band: float = 10.0, cut: float = 50.0, bucket: str = "hour") -> DataFrame:
    """What :func:`hysteresis_tiers` gives for a backlog in one batch, without a ticker's history in one task.

    A tier is set by the last decisive row so far: the ticker's first, or one that leaves the cut by more than the band.
    Rows look back within a ticker and time bucket; what held before a bucket comes from one row for each bucket.
    """
    late = F.col("ts").isNull(), F.col("ts"), F.col("event_id").isNull(), F.col("event_id")  # rows without a time come last
    order = F.struct(*late)
    rows = events.where("value is not null").select(F.col("user_id").alias("ticker"), "event_id", "ts", "value")
    nan = F.isnan("value")  # Spark holds it for larger than any number
    rows = rows.withColumn("bucket", F.date_trunc(bucket, "ts")).withColumn("now", F.when((F.col("value") > cut) & ~nan, "HIGH").otherwise("LOW"))
    rows = rows.withColumn("sure", F.when((F.abs(F.col("value") - cut) > band) & ~nan, F.col("now")))
    sure = F.col("sure").isNotNull()
    ends = rows.groupBy("ticker", "bucket").agg(F.min_by("now", order).alias("first"), F.max_by("sure", F.when(sure, order)).alias("last"))
    own = Window.partitionBy("ticker").orderBy(F.col("bucket").asc_nulls_last())
    held = F.coalesce(F.last("last", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.first("first").over(own))
    before = ends.select("ticker", "bucket", held.alias("held"))
    inside = Window.partitionBy("ticker", "bucket").orderBy(*late).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("tier", F.last("sure", ignorenulls=True).over(inside))
    joined = rows.alias("r").join(before.alias("b"), F.col("r.ticker").eqNullSafe(F.col("b.ticker")) & F.col("r.bucket").eqNullSafe(F.col("b.bucket")))
    return joined.select("r.ticker", "event_id", F.coalesce("tier", "held").alias("tier"))


def run_to_table(stream: DataFrame, at: str | None = None) -> DataFrame:
    """All that is there now, through the stream and into Parquet of the shared folder, and read back; it goes when the driver's Python ends.

    With ``at``, a folder of the caller, a stream goes on where the last one that wrote there ended.
    """
    spark = stream.sparkSession
    at = at or new_folder(spark, "stream")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/data").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/data")


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`run_to_table` for streams that update rows: of each key the row of its last batch stays."""
    spark = stream.sparkSession
    at = new_folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/data/part={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    others = [c for c in stream.columns if c not in keys]
    rows = spark.read.parquet(f"{at}/data").groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r"))
    return rows.select(*keys, "r.*")


def bars_table(events: DataFrame) -> DataFrame:
    """What :func:`latest_bars` keeps of all that is there now."""
    spark = events.sparkSession
    at = new_folder(spark, "stream")
    latest_bars(events, f"{at}/bars")
    return spark.read.parquet(f"{at}/bars")
