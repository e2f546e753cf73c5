"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame that is written as Parquet and read back as the next one's
``docs``.  All but the last return the columns of ``documents``.  Documents that
a stage drops leave by an anti-join with the (few) ids it rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.llm import decontaminate, langid, neardup, packing, suffixdedup
from hazegrid.llm.common import table, tokenizer_path
from hazegrid.session import prepare, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no recognised language: empty, without letters, or undecided."""
    prepare(spark)
    rows = langid.document_rows(docs)
    model = langid.train_text_model(docs.select("lang", "text"))
    rejected = langid.identify(rows, model).where("NOT accepted").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each near-duplicate class."""
    prepare(spark)
    dropped = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has; ``n_chars`` follows the text that is left."""
    prepare(spark)
    left = suffixdedup.texts_left(suffixdedup.remove_repeats(docs))
    rest = docs.drop("text", "n_chars").withColumn("doc_id", F.col("doc_id").cast("long")).dropDuplicates(["doc_id"])
    return left.join(rest, "doc_id").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of at most 4096 tokens."""
    prepare(spark)
    _, placement = packing.pack_documents(docs, tokenizer_path())
    return placement


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the tokenizer, the language model and the tiling
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
