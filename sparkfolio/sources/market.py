"""Market tables made from the driver's tables, by Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.functions.shipping import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; the package goes to the executors with the first one."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per user of ``events``: ticker, date, open, high, low, close, volume, sector, industry (ragged)."""
    order = F.struct("ts", "event_id")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"))
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            (F.count("*") * 100).cast("double").alias("volume"),
        )
        .withColumn("sector", F.concat(F.lit("S"), F.col("ticker") % 5))
        .withColumn("industry", F.concat(F.lit("I"), F.col("ticker") % 11))
    )


def densify(prices: DataFrame) -> DataFrame:
    """One row per calendar date and ticker, missing cells null; the calendar is the dates any ticker has.

    Dates are few and do not grow with the tickers (a century has under 40 000), so the product is as large as the
    panel itself; each ticker's attributes come from its last row.
    """
    dates = prices.select("date").distinct()
    tickers = prices.groupBy("ticker").agg(F.max_by(F.struct("sector", "industry"), "date").alias("a")).select("ticker", "a.*")
    values = prices.drop("sector", "industry")
    return tickers.join(dates).join(values, ["ticker", "date"], "left")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense daily panel with the derived operands: returns, vwap, dollar_volume and adv5."""
    own = Window.partitionBy("ticker").orderBy("date")
    previous = F.lag("close").over(own)
    return (
        densify(prices_daily(spark, sf_dir))
        .withColumn("returns", F.when(previous != 0, F.col("close") / previous - 1))
        .withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3)
        .withColumn("dollar_volume", F.col("close") * F.col("volume"))
        .withColumn("adv5", F.when(F.row_number().over(own) >= 5, F.avg("volume").over(own.rowsBetween(-4, 0))))
    )


#: The same tables in DuckDB's SQL.
PRICES_SQL = """prices AS (
  SELECT user_id AS ticker, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, CAST(count(*) * 100 AS DOUBLE) AS volume,
         'S' || (user_id % 5) AS sector, 'I' || (user_id % 11) AS industry
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""
PANEL_SQL = (
    PRICES_SQL
    + """,
cells AS (
  SELECT t.ticker, d.date, t.sector, t.industry, p.open, p.high, p.low, p.close, p.volume
  FROM (SELECT DISTINCT ticker, sector, industry FROM prices) t CROSS JOIN (SELECT DISTINCT date FROM prices) d
  LEFT JOIN prices p ON p.ticker = t.ticker AND p.date = d.date),
panel AS (
  SELECT *, row_number() OVER w AS rn, close / nullif(lag(close) OVER w, 0) - 1 AS returns, (high + low + close) / 3 AS vwap,
         close * volume AS dollar_volume,
         CASE WHEN row_number() OVER w >= 5 THEN avg(volume) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS adv5
  FROM cells WINDOW w AS (PARTITION BY ticker ORDER BY date))"""
)
