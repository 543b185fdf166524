"""Dictionaries of sentiment: words and their side, read from the caller's file or learned from labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.functions.lexicon import NEGATIVE, POSITIVE, words

#: A learned word stands in so many labelled documents at least, and in this share of them at most: what is in more is grammar.
LEAST, MOST = 3, 0.1
#: Labelled documents that a dictionary is learned from at most.
FIT = 20_000
#: How far the share of good documents with the word must be from that of all.
LEAN = 0.1


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, side of a CSV file with these columns (other columns and rows of other sides are ignored).

    Words are lower-cased and stripped, each word and side once; what is no single word of Latin letters can't be met and goes.
    """
    raw = spark.read.option("header", True).csv(path)
    d = raw.select(F.lower(F.trim("word")).alias("word"), F.lower(F.trim("side")).alias("side"))
    return d.where(F.col("word").rlike("^[a-z]+$") & F.col("side").isin(POSITIVE, NEGATIVE)).distinct()


def learned(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """word, side of words that lean to good or bad documents of ``labels`` (doc_id, quality), one vote a document.

    It is fitted to at most ``FIT`` labelled documents, spread by hash.
    """
    votes = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    votes = votes.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(FIT)
    lab = docs.join(F.broadcast(votes), "doc_id").select("quality", F.array_distinct(words(F.col("text"))).alias("ws"))  # FIT rows at most
    base = lab.agg(F.avg("quality").alias("base"), F.count("*").alias("all"))
    w = lab.select("quality", F.explode("ws").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.avg("quality").alias("share"))
    w = w.where(F.col("word").rlike("^[a-z]+$")).join(F.broadcast(base)).where((F.col("n") >= LEAST) & (F.col("n") <= MOST * F.col("all")))  # one row
    side = F.when(F.col("share") - F.col("base") >= LEAN, POSITIVE).when(F.col("base") - F.col("share") >= LEAN, NEGATIVE)
    return w.select("word", side.alias("side")).where("side is not null")


def write_dictionary(d: DataFrame, path: str) -> None:
    d.select("word", "side").write.option("header", True).csv(path)


LEARNED_SQL = rf"""votes AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT {FIT}),
  lab AS (SELECT quality, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) AS ws FROM documents JOIN votes USING (doc_id)),
  base AS (SELECT avg(quality) AS base, count(*) AS n_all FROM lab),
  lw AS (SELECT word, count(*) AS n, avg(quality) AS share FROM (SELECT quality, unnest(ws) AS word FROM lab) GROUP BY word),
  dict AS (SELECT word, CASE WHEN share - base >= {LEAN}::DOUBLE THEN '{POSITIVE}' WHEN base - share >= {LEAN}::DOUBLE THEN '{NEGATIVE}' END AS side FROM lw, base WHERE regexp_full_match(word, '[a-z]+') AND n >= {LEAST} AND n <= {MOST}::DOUBLE * n_all AND abs(share - base) >= {LEAN}::DOUBLE),
  sides AS (SELECT coalesce(list(word) FILTER (side = '{POSITIVE}'), []) AS {POSITIVE}, coalesce(list(word) FILTER (side = '{NEGATIVE}'), []) AS {NEGATIVE} FROM dict)"""
