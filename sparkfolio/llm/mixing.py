"""Mixing sources to target weights (native).

A token budget flows down a domain - language - source tree by integer weights.  What a node cannot use (its tokens
times the allowed epochs are its cap) goes to its siblings first and to its ancestors' siblings only when the whole
family is full: at each level one window computes the water level.  Each leaf then takes a prefix, in tokens, of its
documents in the seeded order of its last epoch, after as many full epochs as fit.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import columns_of, staged, words_of

LEVELS = ["domain", "lang", "source"]
DOMAINS = ("web", "books", "code", "forum")
DOMAIN_WEIGHTS = {"web": 40, "books": 30, "code": 20, "forum": 10}
LANG_WEIGHTS = {"en": 60, "de": 20, "fr": 20, "es": 10}
DEFAULT_WEIGHT = 10
SEED = 17
BUDGET_PERCENT = 80
MAX_EPOCHS = 3
#: Hexadecimal digits of the order key that make a bucket; 3 cut each leaf into 4096 parts.
BUCKET_DIGITS = 3
SALT_DIGITS = 2


def domain_of(source: Column) -> Column:
    """The four domains of the ``documents`` table, from the number at the end of a source's name."""
    number = F.try_to_number(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1), F.lit("999999999")).cast("int") % 4
    return F.coalesce(F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), number + 1), F.lit("other"))


def _weight(name: Column, weights: Mapping[str, int], default: int) -> Column:
    if not weights:
        return F.lit(default).cast("long")
    pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, name), F.lit(default)).cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str, budget: str, out: str, cap: str, weight: Column) -> DataFrame:
    """One level: ``out`` = floor(least(cap, weight * level)), the level being the largest (budget - caps before) / weights from here on."""
    order = [F.when(F.col("_w") > 0, F.col(cap) / F.col("_w")).asc_nulls_last(), F.col(name)]
    w = Window.partitionBy(*parent).orderBy(*order)
    level = (F.col(budget) - F.coalesce(F.sum(cap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.nullif(
        F.sum("_w").over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(0)
    )
    return (
        nodes.withColumn("_w", weight)
        .withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(Window.partitionBy(*parent)))
        .withColumn(out, F.floor(F.least(F.col(cap).cast("double"), F.col("_w") * F.greatest(F.coalesce("_level", F.lit(0.0)), F.lit(0.0)))).cast("long"))
        .drop("_w", "_level")
    )


def leaf_budgets(
    leaves: DataFrame,
    *,
    budget_tokens: int | None = None,
    budget_percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS,
    lang_weights: Mapping[str, int] = LANG_WEIGHTS,
    source_weights: Mapping[str, int] | None = None,
    default_weight: int = DEFAULT_WEIGHT,
) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``leaf_budget``, for a budget of so many tokens or percent of all.

    Only this table of tree nodes is ranked, never the documents.
    """
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("lang_cap"))
    domains = langs.groupBy("domain").agg(F.sum("lang_cap").alias("domain_cap"))
    total = F.lit(budget_tokens).cast("long") if budget_tokens is not None else F.floor(F.sum("domain_cap").over(Window.partitionBy(F.lit(0))) / max_epochs * budget_percent / 100).cast("long")
    domains = _fill(domains.withColumn("total", total).withColumn("root", F.lit(0)), ["root"], "domain", "total", "domain_budget", "domain_cap", _weight(F.col("domain"), domain_weights, default_weight))
    langs = _fill(langs.join(domains.select("domain", "domain_budget"), "domain"), ["domain"], "lang", "domain_budget", "lang_budget", "lang_cap", _weight(F.col("lang"), lang_weights, default_weight))
    caps = _fill(caps.join(langs.select("domain", "lang", "lang_budget"), ["domain", "lang"]), ["domain", "lang"], "source", "lang_budget", "leaf_budget", "cap", _weight(F.col("source"), source_weights or {}, default_weight))
    return caps.select(*LEVELS, "tokens", "leaf_budget")


def mix(docs: DataFrame, *, seed: int = SEED, bucket_digits: int = BUCKET_DIGITS, n_tokens: Column | None = None, domain: Column | None = None, **budgets) -> DataFrame:
    """One row per chosen document and epoch: doc_id, domain, lang, source, epoch, n_tokens, leaf_budget and ``text_hash``.

    * Tokens are words unless ``n_tokens`` says otherwise.  Texts without words, null ones too, cost nothing and come
      with the prefix they stand in, once the leaf has any tokens; a leaf without tokens gives nothing.
    * Null language or source counts as the name "" in the tree.
    * Repeated rows (same doc_id, text, language, source) are one unit that counts its tokens once for each row and is
      chosen as a whole, one output row for it; ties of the order key are broken by the hash of the text.
    * Weights of 0 give nothing; an empty table gives no rows.
    * A document stays in the prefix while the tokens up to its own end are within what the leaf has left.

    Hot leaves: the order key is a uniform hash, so prefix sums run over its leading digits first and inside one
    (leaf, digits) bucket second; the join of leaf figures to documents is salted.
    """
    base = staged(
        docs.select(
            "doc_id",
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"),
            (domain if domain is not None else domain_of(F.col("source"))).alias("domain"),
            F.coalesce("lang", F.lit("")).alias("lang"),
            F.coalesce("source", F.lit("")).alias("source"),
            (n_tokens if n_tokens is not None else F.size(words_of(F.col("text")))).cast("long").alias("n_tokens"),
        )
        .groupBy("doc_id", "_th", *LEVELS)
        .agg(F.sum("n_tokens").alias("n_tokens"))
    )
    leaves = staged(leaf_budgets(base.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), **budgets))
    salts = F.expr(f"transform(sequence(0, {16**SALT_DIGITS - 1}), i -> lower(lpad(hex(i), {SALT_DIGITS}, '0')))")
    planned = leaves.where("tokens > 0").select(
        *LEVELS, "leaf_budget", F.expr("leaf_budget div tokens").alias("full"), F.expr("leaf_budget % tokens").alias("rest"), F.explode(salts).alias("salt")
    )
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = (
        base.withColumn("salt", F.substring(F.md5(doc), 1, SALT_DIGITS))
        .join(planned, [*LEVELS, "salt"])
        .withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full"), doc)))
        .withColumn("bucket", F.substring("key", 1, bucket_digits))
    )
    leaf = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("t")).select(*LEVELS, "bucket", F.coalesce(F.sum("t").over(leaf), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy(*LEVELS, "bucket").orderBy("key", "_th").rowsBetween(Window.unboundedPreceding, 0)
    times = F.col("full") + ((F.col("start") + F.sum("n_tokens").over(inside)) <= F.col("rest")).cast("long")
    return (
        keyed.join(starts, [*LEVELS, "bucket"])
        .withColumn("times", times)
        .where("times > 0")
        .select("doc_id", F.col("_th").alias("text_hash"), *LEVELS, F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("epoch"), "n_tokens", "leaf_budget")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` chooses, with all their columns, once for each epoch that has them."""
    chosen = mix(docs, **options).select("doc_id", "text_hash", "lang", "source")
    # the row stands aside in a struct, so that none of the names used here can meet its own
    row = F.struct(*columns_of(docs)).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")) & (F.col("l") == F.col("lang")) & (F.col("s") == F.col("source"))
    return keyed.join(chosen, same).select("row.*")
