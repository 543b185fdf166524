"""From raw documents to packed token sequences: five stages over whole texts.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of ``documents`` and leave out others; an empty table stays empty through all stages.
What a stage does with odd rows:

* null and empty texts: rejected by the quality rules; given to a later stage they have no line, shingle or word to lose,
  and become one piece that is only the end mark.
* null doc_id: judged, mixed and packed like others; never a holder of lines and never a near copy.
* repeated rows (same doc_id and text): all get the same verdict and keep the same lines; near deduplication keeps one of
  them, the mix takes rows that are left twice as one unit, and packing packs each row.
* ties: a line stays in the smallest doc_id that holds it, of near copies the smallest doc_id stays, equal keys of the mix
  and equal lengths are ordered by hashes.
* null lang or source: a leaf of its own in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm import line_dedup, minhash, mixing, packing, quality
from sparkfolio.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The mix takes no document twice, and so many percent of the tokens that are left.
MIX = {"max_epochs": 1, "budget_percent": 90}


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``documents``, with another text and its length."""
    replaced = {"text": F.col(text).alias("text"), "n_chars": F.char_length(text).cast("long").alias("n_chars")}
    return docs.select(*[replaced.get(c, F.col(c)) for c in COLUMNS])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return _with_text(quality.judge(docs.select(*COLUMNS)).where("kept"), "clean_text")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document has."""
    return _with_text(line_dedup.drop_repeated_lines(docs.select(*COLUMNS)), "kept_text")


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.deduplicated(docs.select(*COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of domains, languages and sources has room for."""
    return mixing.mixed_documents(docs.select(*COLUMNS), **MIX)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("minhash_near_dedup", near_deduplication),
    ("source_mixing", source_mixing),
    ("best_fit_packing", sequence_packing),
]

#: Token ids are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
