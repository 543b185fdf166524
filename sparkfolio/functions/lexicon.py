"""Sentiment by a dictionary that is data, and classes of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE, NEGATIVE = "positive", "negative"
#: A dictionary of so many words at most is sent to all tasks; a larger one is joined by word.
SENT = 200_000
#: Marks of authors and texts by which events are classed, found anywhere in them.
POLITICAL_AUTHORS = "trump potus harris biden vance desantis ramaswamy kennedy".split()
GEOPOLITICAL_AUTHORS = "fed fomc powell ofac treasury uscbp ustr ecb boj boe pboc sec ftc doj".split()
POLITICAL_WORDS = ["campaign", "election", "senate", "house race", "primary", "rally", "convention", "debate stage", "midterm"]
GEOPOLITICAL_WORDS = [
    "tariff", "sanction", "trade war", "embargo", "regulation", "interest rate", "rate cut", "rate hike", "rate decision", "monetary policy", "fomc", "fed minutes", "ceasefire", "ukraine", "taiwan", "iran",
    "north korea", "ban on", "export control", "antitrust",
]


def words(text: Column) -> Column:
    """Whole words in lower case: runs of letters, digits and underscores, so that a word inside another is none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))


def counted(items: DataFrame, key: str, text: Column, dictionary: DataFrame) -> DataFrame:
    """``key``, good, bad: how many words of each text are on either side of ``dictionary`` (word, side), 0 where none is.

    ``items`` has one row for each key.  A dictionary of checked size goes to the texts; a larger one meets them by word, each
    text's equal words counted before.
    """
    said = items.select(key, F.explode_outer(words(text)).alias("word"))
    if dictionary.count() <= SENT:
        met = said.withColumn("times", F.lit(1)).join(F.broadcast(dictionary), "word", "left")
    else:
        met = said.groupBy(key, "word").agg(F.count("*").alias("times")).join(dictionary, "word", "left")
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("times"))), F.lit(0)).cast("long")
    return met.groupBy(key).agg(side(POSITIVE).alias("good"), side(NEGATIVE).alias("bad"))


def mood(good: Column, bad: Column) -> Column:
    """The side with more than 1.2 times the other's words."""
    return F.when((good > 1.2 * bad) & (good > 0), "bullish").when((bad > 1.2 * good) & (bad > 0), "bearish").otherwise("neutral")


def event_class(author: Column, title: Column, body: Column) -> Column:
    """Geopolitical by author or text, else political by author or text, else other."""
    who = F.lower(F.coalesce(author, F.lit("")))
    what = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))
    has = lambda c, names: F.exists(F.array(*[F.lit(x) for x in names]), lambda x: F.contains(c, x))
    return F.when(has(who, GEOPOLITICAL_AUTHORS) | has(what, GEOPOLITICAL_WORDS), "geopolitical").when(has(who, POLITICAL_AUTHORS) | has(what, POLITICAL_WORDS), "political").otherwise("other")


def sql_hits(text: str, side: str) -> str:
    """Words of a text in a side's list, a column of the one row of ``sides``."""
    found = f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]+')"
    return f"CAST(len(list_filter({found}, lambda x: list_contains({side}, x))) AS BIGINT)"


def sql_mood(good: str, bad: str) -> str:
    return f"CASE WHEN {good} > 1.2 * {bad} AND {good} > 0 THEN 'bullish' WHEN {bad} > 1.2 * {good} AND {bad} > 0 THEN 'bearish' ELSE 'neutral' END"


def sql_event_class(author: str, title: str, body: str) -> str:
    what = f"lower(coalesce({title}, '') || ' ' || coalesce({body}, ''))"
    has = lambda c, names: "(" + " OR ".join(f"contains({c}, '{x}')" for x in names) + ")"
    who = f"lower(coalesce({author}, ''))"
    return f"CASE WHEN {has(who, GEOPOLITICAL_AUTHORS)} OR {has(what, GEOPOLITICAL_WORDS)} THEN 'geopolitical' WHEN {has(who, POLITICAL_AUTHORS)} OR {has(what, POLITICAL_WORDS)} THEN 'political' ELSE 'other' END"
