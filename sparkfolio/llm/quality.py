"""Quality rules, line first (native).

Every line is judged by rules on punctuation, navigation and boilerplate; failing lines go; a document that loses too
much of its text is rejected.  Document-level base figures (repeated word windows, symbols, repeated lines) are
computed beside it inside the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import SPACE, columns_of, lines_of, words_of

SYMBOLS = "[#*$%&|<>]"
#: Fixed phrases of pages around the text proper; only short lines are held against them.
BOILERPLATE = (
    "(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|"
    "javascript (is|must be) |subscribe to our|sign up for our|click here to|share this|follow us on|"
    "accept (all )?cookies|lorem ipsum)"
)
MENU = "(?i)^\\W*(home|menu|login|log in|sign in|register|search|contact|about us|next|previous|back to top)\\W*$"
BOILERPLATE_MAX_CHARS = 200
MENU_MAX_CHARS = 30
MAX_SYMBOL_SHARE = 0.1
NAV_SEPARATORS = 4
UNPUNCTUATED_WORDS = 20
MAX_LOST_SHARE = 0.5
#: A line of at least UNPUNCTUATED_WORDS words.
LONG = f"^{SPACE}*([^\\x20\\x09-\\x0D]+{SPACE}+){{{UNPUNCTUATED_WORDS - 1}}}[^\\x20\\x09-\\x0D]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def line_fails(line: Column) -> Column:
    """True where a line breaks a rule: mostly symbols, a bar of links, a menu entry, boilerplate, or long without any punctuation."""
    chars = F.char_length(line)
    symbols = chars - F.char_length(F.regexp_replace(line, SYMBOLS, ""))
    bars = chars - F.char_length(F.replace(line, F.lit("|"), F.lit("")))
    return (
        (symbols > chars * MAX_SYMBOL_SHARE)
        | (bars >= NAV_SEPARATORS)
        | ((chars <= MENU_MAX_CHARS) & line.rlike(MENU))
        | ((chars <= BOILERPLATE_MAX_CHARS) & line.rlike(BOILERPLATE))
        | (~line.rlike("[.,;:!?]") & line.rlike(LONG))
    )


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the figures, the verdict and ``clean_text`` (text without failing lines).

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars (long), base_failed, kept
    (boolean), clean_text.  Null and empty texts have no words and fail.  Rows are judged one by one, so repeated rows
    and null ids need no care.  Columns of the input named as the ones added are replaced.
    """
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "clean_text")
    # the row's own columns stand aside in a struct, so that none of the names used here can meet theirs
    base = columns_of(docs, without=own)
    text = F.coalesce("text", F.lit(""))
    out = (
        docs.select(F.struct(*base).alias("_row"), "text")
        .withColumn("_words", words_of(F.col("text")))
        .withColumn("_lines", lines_of(F.col("text")))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("_worded", F.filter("_lines", lambda l: l.rlike("[^\\x20\\x09-\\x0D]")))
        .withColumn("_good", F.filter("_lines", lambda l: ~line_fails(l)))
        .withColumn("_h", _windows())
        .withColumn("_twice", F.size(F.array_distinct("_h")) < F.size("_h"))
        .withColumn("_sorted", F.when(F.col("_twice"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
        .withColumn("_at", F.when(F.col("_twice"), _repeated_starts()))
        .withColumn("clean_text", F.array_join("_good", "\n"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        out.select(
            "_row",
            "text",
            "n_words",
            F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"),
            F.when(F.col("_twice"), _covered()).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
            (F.char_length(text) - F.char_length("clean_text")).cast("long").alias("lost_chars"),
            "clean_text",
        )
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("lost_chars") <= MAX_LOST_SHARE * F.char_length(text)))
        # a filter on the verdict must not be pushed below, where it would repeat the array work inside itself
        .select(F.explode(F.array(F.struct("_row", *own))).alias("row"))
        .select("row._row.*", *[F.col("row")[c].alias(c) for c in own])
    )


def _windows() -> Column:
    """A hash for each window of three words."""
    w, n = F.col("_words"), F.col("n_words")
    return F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), (n - 3).cast("int")), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeated_starts() -> Column:
    """Sorted starts of the windows whose hash has a neighbour of the same value in sorted order."""
    s = F.col("_sorted")
    return F.sort_array(
        F.transform(
            F.filter(
                F.transform(
                    s,
                    lambda x, i: F.struct(
                        x["p"].alias("p"),
                        (
                            F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
                        ).alias("same"),
                    ),
                ),
                lambda x: x["same"],
            ),
            lambda x: x["p"],
        )
    )


def _covered() -> Column:
    """How many words lie in a repeated window: the length of the union of [p, p + 3)."""
    return F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"), (p + 3).alias("end")),
        lambda acc: acc["n"],
    )
