"""Readers and writers of price stores, membership files, vendor tables and insider filings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
PRICES = {"date": "date", "ticker": "string", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double"}


def read_panel(spark: SparkSession, path: str, benchmarks: Sequence) -> tuple[DataFrame, DataFrame]:
    """A long price panel of Parquet files: the universe, and the benchmarks' rows apart from it."""
    df = spark.read.parquet(path)
    is_benchmark = F.col("ticker").isin(*benchmarks)
    return df.where(~is_benchmark), df.where(is_benchmark)


def bucket(ticker: Column) -> Column:
    """The folder of a ticker: so many, however many tickers there are."""
    return F.pmod(F.xxhash64(ticker.cast("string")), F.lit(BUCKETS)).cast("int")


def write_cache(bars: DataFrame, path: str) -> None:
    """Bars dealt to folders by ticker: a folder that new bars touch is written anew as a whole, the others stay."""
    dealt = bars.withColumn("bucket", bucket(F.col("ticker"))).repartition("bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_cache(spark: SparkSession, path: str, tickers: Sequence | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Bars of some tickers (all if none are given) and days: only their folders are listed, and days are pushed to the files."""
    df = spark.read.parquet(path)
    if tickers is not None:
        folders = spark.range(1).select(F.array(*[bucket(F.lit(t)) for t in tickers]).alias("b")).first()["b"]
        df = df.where(F.col("bucket").isin(*set(folders)) & F.col("ticker").isin(*tickers))
    if since is not None:
        df = df.where(F.col("date") >= F.lit(since).cast("date"))
    if until is not None:
        df = df.where(F.col("date") <= F.lit(until).cast("date"))
    return df.drop("bucket")


def update_cache(spark: SparkSession, path: str, bars: DataFrame, stage) -> None:
    """Write new bars back: of one ticker and day the new one wins.  ``stage`` writes the merged folders aside first, as they are read while they are replaced."""
    touched = bars.select(bucket(F.col("ticker")).alias("bucket")).distinct()
    old = spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi").drop("bucket")  # at most BUCKETS rows
    merged = bars.unionByName(old.join(bars, ["ticker", "date"], "left_anti"))
    write_cache(stage(merged), path)


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """Index snapshots of CSV files (date, comma-joined tickers): one row per date and ticker, ``.`` in symbols as ``-``."""
    raw = spark.read.option("header", True).schema("date date, tickers string").csv(path)
    one = raw.select("date", F.explode(F.split("tickers", ",")).alias("t")).select("date", F.regexp_replace(F.btrim("t"), "\\.", "-").alias("ticker"))
    return one.where("ticker <> ''").distinct()


def normalize(vendor: DataFrame, names: Mapping[str, str], schema: Mapping[str, str] = PRICES) -> DataFrame:
    """A vendor's table in one schema: columns renamed, cast where they can be (else null), missing ones null, others left out."""
    df = vendor.withColumnsRenamed(dict(names))
    have = {c.lower(): c for c in df.columns}
    cell = lambda c, kind: F.col(f"`{have[c]}`").try_cast(kind) if c in have else F.lit(None).cast(kind)
    return df.select(*[cell(c, kind).alias(c) for c, kind in schema.items()])


def upsert(stored: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """``stored`` (ticker, date, close) with ``new`` rows merged in: null and non-positive closes are refused, of one key the latest new row wins."""
    good = new.where("close > 0").groupBy("ticker", "date").agg(F.max_by("close", order).alias("close"))
    return good.unionByName(stored.select("ticker", "date", "close").join(good, ["ticker", "date"], "left_anti"))


FORM = """reportingOwner struct<reportingOwnerId:struct<rptOwnerName:string>>, nonDerivativeTable struct<nonDerivativeTransaction:array<struct<transactionDate:struct<value:string>,transactionCoding:struct<transactionCode:string>,
  transactionAmounts:struct<transactionShares:struct<value:string>,transactionPricePerShare:struct<value:string>,transactionAcquiredDisposedCode:struct<value:string>>>>>"""


def insider_days(forms: DataFrame) -> DataFrame:
    """Forms (ticker, xml) as net value, buys and sells per ticker and day: open-market purchases and sales only, disposals negative."""
    t = forms.select("ticker", F.explode(F.from_xml("xml", FORM)["nonDerivativeTable"]["nonDerivativeTransaction"]).alias("t"))
    amounts = F.col("t.transactionAmounts")
    shares, price = amounts["transactionShares"]["value"].try_cast("double"), F.coalesce(amounts["transactionPricePerShare"]["value"].try_cast("double"), F.lit(0.0))
    side = amounts["transactionAcquiredDisposedCode"]["value"]
    rows = t.select("ticker", F.col("t.transactionDate.value").try_cast("date").alias("date"), F.col("t.transactionCoding.transactionCode").alias("code"), (F.when(side == "A", 1.0).when(side == "D", -1.0).otherwise(0.0) * shares * price).alias("dollars"))
    rows = rows.where("date is not null and dollars is not null and code in ('P', 'S')")
    return rows.groupBy("ticker", "date").agg(F.sum("dollars").alias("net_dollars"), F.count_if(F.col("code") == "P").alias("n_buys"), F.count_if(F.col("code") == "S").alias("n_sells"))


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], parts: int = 256) -> DataFrame:
    """One row of linear-interpolated quantiles (q0, q1, ...) of a column, without sorting it in one task.

    Approximate cuts deal the values to ranges; counts give each range's first place, so only the values at the wanted
    places are numbered inside their ranges and met by their exact ranks.
    """
    x = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    cuts = x.agg(F.percentile_approx("x", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000).alias("cuts"))
    dealt = x.join(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")  # one row
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    all_parts = Window.partitionBy(F.lit(0))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(all_parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(all_parts))
    places = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(q)) * (F.col("total") - 1)).alias("at")) for k, q in enumerate(shares)])
    ends = F.array(F.floor("w.at"), F.ceil("w.at"))
    wanted = counts.select("part", "before", "n", F.explode(places).alias("w")).select("part", "before", "n", "w.k", "w.at", F.explode(F.array_distinct(ends)).alias("place")).where("place >= before and place < before + n")
    parts_wanted = wanted.select("part", "before").distinct()
    numbered = dealt.join(F.broadcast(parts_wanted), "part").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("x")) - 1)  # two parts a share at most
    hit = wanted.select("part", "k", "at", "place").join(numbered.select("part", "place", "x"), ["part", "place"])
    weight = 1 - F.abs(F.col("at") - F.col("place"))
    return hit.groupBy("k").agg(F.sum(F.col("x") * weight).alias("q")).groupBy().agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(f"q{k}") for k in range(len(shares))])
