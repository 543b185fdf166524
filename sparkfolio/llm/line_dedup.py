"""Line-level deduplication across documents (native).

Explode normalised lines, hash, find the keys of two or more documents by one aggregate, drop those lines but in the
smallest document, and put the rest together by position.  Two 64-bit hashes with different seeds stand for a line's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import ascii_lower, columns_of, lines_of, staged

MIN_KEY_CHARS = 10
#: A key is hot with more than one in so many lines; there are fewer such keys than this.
HOT_SHARE = 1000


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def drop_repeated_lines(docs: DataFrame, min_key_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    * A key of at least ``min_key_chars`` code points that two or more doc_ids hold loses all its lines but those in
      the smallest doc_id.  Repeats inside that one document stay.
    * Null text: one empty line, which is never dropped.  Null doc_id: the row stays whole and is no holder of keys.
    * Repeated rows (same doc_id and text) all get the same answer; rows of one doc_id with other texts count as one document.
    * Columns of the input named as the ones added are replaced; other names, with dots or used here too, are left alone.

    Hot keys: holders are found by min, max and count with map-side combining.  Keys with more than a thousandth of all
    lines are a thousand at most, so this table of known size is broadcast to their lines; the lines of all other keys
    meet theirs by a join in which no key can fill more than a thousandth.
    """
    added = ("kept_text", "n_lines", "n_dropped")
    # the row stands aside in a struct; it is known by (doc_id, hash of its text): repeated doc_ids cannot mix their positions
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), F.col("doc_id").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("text").alias("line_text"))
    hashed = F.transform(lines_of(F.col("line_text")), lambda l: _hashes(line_key(l), min_key_chars))
    keyed = rows.where(F.col("doc").isNotNull()).select("doc", "th", F.posexplode(hashed).alias("pos", "h"))
    lines = staged(keyed.where(F.col("h").isNotNull()).select("doc", "th", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b")))
    found = lines.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
    repeated = staged(found.where("first < last").drop("last"))
    most = max(lines.count() // HOT_SHARE, 1)
    hot = F.broadcast(repeated.where(F.col("n") > most).drop("n"))  # fewer than HOT_SHARE rows
    cold = lines.join(hot, ["a", "b"], "left_anti").join(repeated.where(F.col("n") <= most).drop("n"), ["a", "b"])
    gone = lines.join(hot, ["a", "b"]).unionByName(cold).where("doc <> first").groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("doc").alias("gone_doc"), F.col("th").alias("gone_th"), "gone")
    out = rows.join(gone, (F.col("doc") == F.col("gone_doc")) & (F.col("th") == F.col("gone_th")), "left").withColumn("lines", lines_of(F.col("line_text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("line_text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    # lambdas take their names from the select they stand in first, so the row's own columns come back in one of their own
    out = out.select("row", kept.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added], *added)


def _hashes(key: Column, least: int) -> Column:
    return F.when(
        F.char_length(key) >= least,
        F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b")),
    )
