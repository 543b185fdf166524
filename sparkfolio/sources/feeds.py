"""News and macro events made from the given tables, and vendor payloads read into one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.sources.market import table

#: Buckets of impact and direction, and what a dictionary's verdict stands for.
IMPACT = {"none": 0.0, "low": 0.3, "medium": 0.7, "high": 1.0}
DIRECTION = {"bullish": 1, "bearish": -1, "neutral": 0}


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per event that has a document: item_id, ticker, source, headline, url, published_at, impact, direction (some null)."""
    e = table(spark, sf_dir, "events").where("ts is not null")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("headline"))
    n = F.col("event_id")
    pick = lambda k, *values: F.get(F.array(*[F.lit(v) for v in values]), (n % k).cast("int"))
    return e.join(d, F.col("event_id") == F.col("doc_id")).select(
        n.alias("item_id"), F.concat(F.lit("t"), F.col("user_id")).alias("ticker"), pick(3, "alpha", "beta", "gamma").alias("source"), "headline",
        F.concat(F.lit("HTTPS://News.Example.COM/Story/"), n % 100, F.lit("?utm="), n).alias("url"), F.col("ts").cast("timestamp").alias("published_at"),
        pick(5, *IMPACT).alias("impact"), pick(4, *DIRECTION).alias("direction"),
    )


def macro_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per turn of a conversation: event_id, author, title, body, published_at, tickers (array), impact, direction."""
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 100 + F.col("turn")
    pick = lambda k, *values: F.get(F.array(*[F.lit(v) for v in values]), (n % k).cast("int"))
    name = lambda x: F.concat(F.lit("t"), x % 150)
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("conv_id") * 37 + F.col("turn")) % 43200 * 60)
    return c.where("conv_id is not null and turn is not null").select(
        n.alias("event_id"), F.concat(F.col("role"), pick(6, " fed", " potus", "", " wire", " treasury", "")).alias("author"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("title"),
        F.coalesce("text", F.lit("")).alias("body"), at.alias("published_at"), F.array_distinct(F.array(name(F.col("conv_id")), name(F.col("conv_id") + F.col("turn")))).alias("tickers"),
        pick(5, *IMPACT).alias("impact"), pick(4, *DIRECTION).alias("direction"),
    )


_PICK = lambda k, values, n: "CASE " + f"{n} % {k} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
NEWS_SQL = f"""news AS (SELECT event_id AS item_id, 't' || user_id AS ticker, {_PICK(3, ["alpha", "beta", "gamma"], "event_id")} AS source, split_part(coalesce(text, ''), chr(10), 1) AS headline,
    'HTTPS://News.Example.COM/Story/' || (event_id % 100) || '?utm=' || event_id AS url, ts AS published_at, {_PICK(5, IMPACT, "event_id")} AS impact, {_PICK(4, DIRECTION, "event_id")} AS direction FROM events JOIN documents ON doc_id = event_id WHERE ts IS NOT NULL)"""
_N = "(conv_id * 100 + turn)"
MACRO_SQL = f"""macro AS (SELECT {_N} AS event_id, role || {_PICK(6, [" fed", " potus", "", " wire", " treasury", ""], _N)} AS author, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS body,
    to_timestamp(1704067200 + (conv_id * 37 + turn) % 43200 * 60)::TIMESTAMP AS published_at, list_distinct(['t' || (conv_id % 150), 't' || ((conv_id + turn) % 150)]) AS tickers, {_PICK(5, IMPACT, _N)} AS impact, {_PICK(4, DIRECTION, _N)} AS direction FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"""


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, without query and fragment."""
    head = F.lower(F.regexp_extract(url, "^([a-zA-Z]+://[^/?#]*)", 1))
    return F.concat(head, F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z]+://[^/?#]*", ""), "[?#].*$", ""))


def normal_headline(headline: Column) -> Column:
    """Lower case, ASCII punctuation as blanks, blanks squeezed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(headline), "[!-/:-@\\[-`{-~]", " "), "\\s+", " "))


def story_hash(ticker: Column, url: Column, headline: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.upper(F.coalesce(ticker, F.lit(""))), normal_url(url), normal_headline(headline)), 256)


HASH_SQL = r"""sha256(upper(coalesce(ticker, '')) || '|' || lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', '') || '|' || trim(regexp_replace(regexp_replace(lower(headline), '[!-/:-@\[-`{-~]', ' ', 'g'), '\s+', ' ', 'g')))"""

JSON_ITEM = "array<struct<id:long,headline:string,url:string,datetime:long,summary:string>>"


def read_json_payloads(payloads: DataFrame, now: Column) -> DataFrame:
    """Items of JSON payloads (ticker, source, payload): one row for each entry of a list that has a url and a headline.

    A payload that is no list gives nothing; a time that is missing is ``now``.
    """
    items = payloads.select("ticker", "source", F.explode(F.from_json("payload", JSON_ITEM)).alias("i"))
    time = F.coalesce(F.timestamp_seconds(F.when(F.col("i.datetime") != 0, F.col("i.datetime"))), now)
    full = items.where("i.url <> '' and i.headline <> ''")
    return full.select(F.upper("ticker").alias("ticker"), "source", F.col("i.id").cast("string").alias("source_id"), F.col("i.headline").alias("headline"), F.col("i.url").alias("url"), time.alias("published_at"), F.col("i.summary").alias("summary"))


RSS = "channel struct<item:array<struct<title:string,link:string,guid:string,pubDate:string,description:string>>>"


def read_rss_payloads(payloads: DataFrame, since: Column, now: Column) -> DataFrame:
    """Entries of RSS payloads (source, payload): those with a title, published since a time; a time that can't be read is ``now``."""
    items = payloads.select("source", F.explode(F.from_xml("payload", RSS)["channel"]["item"]).alias("i")).where("i.title <> ''")
    plain = F.regexp_replace("i.pubDate", "^[A-Za-z]{3}, ", "")
    items = items.withColumn("published_at", F.coalesce(F.try_to_timestamp(plain, F.lit("dd MMM yyyy HH:mm:ss Z")), now)).where(F.col("published_at") >= since)
    return items.select("source", F.col("i.guid").alias("source_id"), F.col("source").alias("author"), F.col("i.title").alias("title"), F.when(F.col("i.link") != "", F.col("i.link")).alias("url"), F.col("i.description").alias("body"), "published_at")
