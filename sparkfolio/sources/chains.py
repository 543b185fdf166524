"""Option chains: one row for each contract, as a vendor's file has them, and a chain made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.sources.market import table

#: Columns of a chain: ``kind`` is call or put, ``iv`` a share and not in percent.
CHAIN = {"ticker": "long", "as_of": "date", "expiry": "date", "kind": "string", "strike": "double", "iv": "double", "volume": "double", "open_interest": "double"}
#: How long before the last expiry a made chain is looked at.
BEFORE_END = 120


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """A chain of Parquet files with columns in any order and of any numbers; other columns are ignored, missing ones are null.

    ``kind`` may be written in any case; contracts that are neither call nor put go.
    """
    raw = spark.read.parquet(path)
    there = {c.lower(): c for c in raw.columns}
    c = raw.select(*[(F.col(there[n]) if n in there else F.lit(None)).cast(t).alias(n) for n, t in CHAIN.items()])
    return c.withColumn("kind", F.lower(F.trim("kind"))).where(F.col("kind").isin("call", "put"))


def option_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of monthly expiries from ``lineitem``: a contract for each line, its price the strike and its quantity volume and open interest."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("ticker"),
        F.last_day("l_shipdate").alias("expiry"),
        F.when(F.col("l_returnflag") == "R", "put").otherwise("call").alias("kind"),
        (F.col("l_extendedprice") / F.col("l_quantity") * (1 - F.col("l_discount"))).cast("double").alias("strike"),
        (0.1 + 5 * F.col("l_discount")).cast("double").alias("iv"),
        F.col("l_quantity").cast("double").alias("volume"),
        F.col("l_quantity").cast("double").alias("open_interest"),
    )
    now = table(spark, sf_dir, "lineitem").agg(F.date_sub(F.max(F.last_day("l_shipdate")), BEFORE_END).alias("as_of"))
    return lines.join(F.broadcast(now)).select(*CHAIN)  # one row


def nearest_expiry(chain: DataFrame) -> DataFrame:
    """Contracts of each ticker's first expiry that has not passed, with ``tau``: years to it, half a day at least."""
    open_ = chain.where("expiry >= as_of")
    first = open_.groupBy("ticker").agg(F.min("expiry").alias("expiry"))
    return open_.join(first, ["ticker", "expiry"]).withColumn("tau", F.greatest(F.datediff("expiry", "as_of").cast("double"), F.lit(0.5)) / 365.0)


CHAIN_SQL = f"""chain AS (SELECT l_suppkey AS ticker, last_day(CAST(l_shipdate AS DATE)) AS expiry, CASE WHEN l_returnflag = 'R' THEN 'put' ELSE 'call' END AS kind, CAST(l_extendedprice / l_quantity * (1 - l_discount) AS DOUBLE) AS strike,
    CAST(0.1 + 5 * l_discount AS DOUBLE) AS iv, CAST(l_quantity AS DOUBLE) AS volume, CAST(l_quantity AS DOUBLE) AS open_interest, (SELECT max(last_day(CAST(l_shipdate AS DATE))) FROM lineitem) - {BEFORE_END} AS as_of FROM lineitem),
  nearest AS (SELECT *, greatest(CAST(date_diff('day', as_of, expiry) AS DOUBLE), 0.5) / 365.0 AS tau FROM chain WHERE expiry >= as_of QUALIFY expiry = min(expiry) OVER (PARTITION BY ticker))"""
