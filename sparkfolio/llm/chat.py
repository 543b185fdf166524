"""Chat formatting (native): turn structs are collected, sorted, merged by role and put together by expressions alone.

A block of the template holds adjacent turns of one role::

    ### role: first text <+> second text </turn>

and a line feed.  ``\\``, ``#`` and ``<`` of texts (and ``:`` of roles) are escaped by a backslash, so no marker can
occur inside a text, and unescaping gives back what was there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, COLON, JOIN, CLOSE = "### ", ": ", " <+> ", " </turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column, also: str = "") -> Column:
    """A backslash before each backslash, ``#`` and ``<`` (and each character of ``also``)."""
    return F.regexp_replace(text, f"([\\\\#<{also}])", "\\\\$1")


def unescape(text: Column) -> Column:
    """What :func:`escape` was given."""
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conv_id of ``turns`` (conv_id, turn, role, text): ``formatted`` and ``loss_spans``.

    ``loss_spans`` is an array of (start, length), in code points from 0, of the texts of ``loss_role`` inside
    ``formatted``: each text's own span, markers left out.

    * Turns are ordered by (turn, role, text), nulls first, so equal turn numbers have a defined order and repeated
      rows all count.  Null text or role is empty; an empty text keeps its turn.
    * Rows without conv_id make one conversation without id.  Other columns are ignored.  An empty table gives no rows.
    * Roles and texts may have any length, and a conversation any number of turns that one row can hold.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    block = F.transform(
        "blocks",
        lambda b: F.concat(F.lit(OPEN), escape(b["role"], ":"), F.lit(COLON), F.array_join(F.transform(b["texts"], lambda t: escape(t)), JOIN), F.lit(CLOSE)),
    )
    return (
        turns.select("conv_id", turn.alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .withColumn("blocks", _merged(F.col("turns")))
        .withColumn("parts", block)
        .withColumn("sized", _sized())
        .withColumn("starts", running(F.transform("sized", lambda b: b["total"])))
        .select("conv_id", F.array_join("parts", "").alias("formatted"), _spans(loss_role).alias("loss_spans"))
    )


def _merged(turns: Column) -> Column:
    """Adjacent turns of one role as one struct (role, texts): a block runs from one change of role to the next."""
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(starts, 2, F.size(turns)), F.array(F.size(turns)))
    return F.zip_with(
        starts,
        ends,
        lambda a, b: F.struct(F.get(turns, a)["role"].alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda t: t["text"]).alias("texts")),
    )


def _sized() -> Column:
    """For each block its role, the length of its head, those of its texts and what stands before each, and its own."""

    def size(b: Column) -> Column:
        lengths = F.transform(b["texts"], lambda t: F.char_length(escape(t)))
        head = F.char_length(escape(b["role"], ":")) + len(OPEN) + len(COLON)
        inner = F.aggregate(lengths, F.lit(0).cast("long"), lambda acc, n: acc + n + len(JOIN)) - len(JOIN)
        before = running(F.transform(lengths, lambda n: n + len(JOIN)))
        return F.struct(b["role"].alias("role"), head.alias("head"), lengths.alias("lengths"), before.alias("before"), (head + inner + len(CLOSE)).alias("total"))

    return F.transform("blocks", size)


def _spans(loss_role: str) -> Column:
    """Spans of the loss role's texts: a text starts where its block does, after the head and what stands before it there."""
    spans = F.zip_with(
        "sized",
        "starts",
        lambda b, at: F.when(
            b["role"] == loss_role,
            F.zip_with(b["lengths"], b["before"], lambda n, x: F.struct((at + b["head"] + x).cast("int").alias("start"), n.cast("int").alias("length"))),
        ).otherwise(F.array().cast("array<struct<start:int,length:int>>")),
    )
    return F.flatten(spans)


#: Arrays of so many entries are summed without chunks.
FEW = 32


def running(lengths: Column) -> Column:
    """Sums of what stands before each entry of an array, in chunks: the sums inside a chunk look at no more than it, and one fold goes over the chunks' totals."""
    n = F.size(lengths)
    chunk = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
    sum_of = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda acc, v: acc + v)
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / chunk).cast("int") - 1, F.lit(0))), lambda k: F.slice(lengths, k * chunk + 1, chunk))
    totals = F.transform(chunks, sum_of)
    bases = F.transform(totals, lambda _, k: sum_of(F.slice(totals, F.lit(1), k)))
    inner = F.zip_with(chunks, bases, lambda c, base: F.transform(c, lambda _, i: base + sum_of(F.slice(c, F.lit(1), i))))
    return F.when(n <= FEW, F.transform(lengths, lambda _, i: sum_of(F.slice(lengths, F.lit(1), i)))).otherwise(F.flatten(inner))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns (array of role, text) and the unescaped loss text of :func:`format_conversations`, from its output alone."""
    close, join = F.lit("\\Q" + CLOSE + "\\E"), F.lit("\\Q" + JOIN + "\\E")
    # possessive: a role of any length is read without a stack that grows with it, and never given back
    head = "(?s)^### ([^\\\\:]*+(?:\\\\.[^\\\\:]*+)*+): (.*)$"
    blocks = F.array_remove(F.split("formatted", close, -1), "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_extract(b, head, 2), join, -1),
                lambda t: F.struct(unescape(F.regexp_extract(b, head, 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "")
    return formatted.withColumn("turns", turns).withColumn("loss_text", loss)
