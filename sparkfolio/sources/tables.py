"""More tables of equity research, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.sources.market import table

#: How many tickers filings and orders are dealt to.
TICKERS = 150
SIGNALS = {"momentum": 0.7, "reversal": 0.5, "activity": 0.4}
WEIGHTS = {"momentum": 0.5, "reversal": 0.3, "activity": 0.2}


def prices_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly mean price and volume per supplier of ``lineitem``: ticker, date (Monday), close, volume."""
    price = F.col("l_extendedprice") / F.col("l_quantity") * (1 - F.col("l_discount"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("ticker"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"))
        .agg(F.avg(price.cast("double")).alias("close"), F.sum(F.col("l_quantity").cast("double")).alias("volume"))
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements from ``orders``: ticker, filing_date, filing_id, amount."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % TICKERS + 1).alias("ticker"),
        F.col("o_orderdate").cast("date").alias("filing_date"),
        F.col("o_orderkey").alias("filing_id"),
        F.col("o_totalprice").cast("double").alias("amount"),
    )


WEEKLY_SQL = """weekly AS (
  SELECT l_suppkey AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         avg(CAST(l_extendedprice / l_quantity * (1 - l_discount) AS DOUBLE)) AS close, sum(CAST(l_quantity AS DOUBLE)) AS volume
  FROM lineitem GROUP BY ALL)"""
FILINGS_SQL = f"""filings AS (
  SELECT o_custkey % {TICKERS} + 1 AS ticker, CAST(o_orderdate AS DATE) AS filing_date, o_orderkey AS filing_id, CAST(o_totalprice AS DOUBLE) AS amount FROM orders)"""


def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars per supplier of ``lineitem`` (ragged), a price being that of one piece after discount.

    ticker, date (Monday), open, high, low, close, volume, industry (nation), sector (region).
    """
    price = F.col("l_extendedprice") / F.col("l_quantity") * (1 - F.col("l_discount"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    bars = (
        table(spark, sf_dir, "lineitem")
        .withColumn("price", price)
        .groupBy(F.col("l_suppkey").alias("ticker"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )
    return bars.join(_places(spark, sf_dir), "ticker", "left")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, industry and sector of the suppliers."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return places.select(F.col("s_suppkey").alias("ticker"), F.col("n_name").alias("industry"), F.col("r_name").alias("sector"))


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, k (its number from 0) and size of the weeks of ``lineitem``: few rows."""
    line = Window.partitionBy(F.lit(0)).orderBy("date")
    dates = table(spark, sf_dir, "lineitem").select(F.date_trunc("week", "l_shipdate").cast("date").alias("date")).distinct()
    return dates.select("date", (F.row_number().over(line) - 1).alias("k"), F.count("*").over(Window.partitionBy(F.lit(0))).cast("int").alias("size"))


def panel_weekly(spark: SparkSession, sf_dir: str, places: bool = True) -> DataFrame:
    """The dense weekly panel: all dates of all tickers, with returns, vwap and dollar_volume; without ``places`` no industry and sector.

    Lines are dealt once, by ticker, and all else is done where they lie: bars, gaps (a bar also makes the empty cells up to the
    next one, the first also those before it) and the windows of what is asked of the panel by ticker.
    """
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount").repartition("ticker")
    lines = lines.withColumn("price", F.col("l_extendedprice") / F.col("l_quantity") * (1 - F.col("l_discount"))).withColumn("date", F.date_trunc("week", "l_shipdate").cast("date"))
    bars = lines.groupBy("ticker", "date").agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("l_quantity").alias("volume"))
    days, own = F.broadcast(weeks(spark, sf_dir)), Window.partitionBy("ticker").orderBy("date")
    at = bars.join(days.withColumnRenamed("date", "week"), F.col("date").eqNullSafe(F.col("week")))
    first = F.when(F.lag("k").over(own).isNull(), 0).otherwise(F.col("k"))
    gaps = at.withColumn("first", first).withColumn("last", F.coalesce(F.lead("k").over(own), F.col("size")) - 1)
    here = (F.col("cell") == F.col("k")) & F.col("ticker").isNotNull() & F.col("date").isNotNull()  # null keys meet no bar
    cells = gaps.withColumn("cell", F.explode(F.sequence("first", "last"))).select("ticker", "cell", *[F.when(here, F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")])
    dense = cells.join(days.select("date", F.col("k").alias("cell")), "cell").select("ticker", "date", "open", "high", "low", "close", "volume")
    if places:
        dense = dense.join(_places(spark, sf_dir), "ticker", "left")
    previous = F.lag("close").over(own)
    return (
        dense.withColumn("returns", F.when(previous != 0, F.col("close") / previous - 1))
        .withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3)
        .withColumn("dollar_volume", F.col("close") * F.col("volume"))
    )


BARS_SQL = """lines AS (SELECT *, l_extendedprice / l_quantity * (1 - l_discount) AS p FROM lineitem),
bars AS (
  SELECT l_suppkey AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         arg_min(p, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open, max(p) AS high, min(p) AS low,
         arg_max(p, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close, sum(l_quantity) AS volume
  FROM lines GROUP BY ALL),
places AS (SELECT s_suppkey AS ticker, n_name AS industry, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
wbars AS (SELECT b.*, industry, sector FROM bars b LEFT JOIN places USING (ticker))"""
WPANEL_SQL = (
    BARS_SQL
    + """,
wcells AS (
  SELECT t.ticker, d.date, t.industry, t.sector, b.open, b.high, b.low, b.close, b.volume
  FROM (SELECT DISTINCT ticker, industry, sector FROM wbars) t CROSS JOIN (SELECT DISTINCT date FROM wbars) d LEFT JOIN wbars b ON b.ticker = t.ticker AND b.date = d.date),
wpanel AS (
  SELECT *, row_number() OVER w AS rn, close / nullif(lag(close) OVER w, 0) - 1 AS returns, (high + low + close) / 3 AS vwap, close * volume AS dollar_volume
  FROM wcells WINDOW w AS (PARTITION BY ticker ORDER BY date))"""
)
