"""The corpus pipeline: quality filter, line deduplication, near-duplicates, decontamination, packing.

Each stage works on all that the one before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import decontaminate, lines, minhash, packing, quality, runtime

TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7; null and empty texts are scored like any other."""
    model = quality.trained(docs, runtime.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go, and documents of which nothing but white space is left by that."""
    out = lines.drop_repeated_lines(docs)
    left = out.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays, and one row of each doc_id; rows without a doc_id stay."""
    key, rows = runtime.fresh(docs.columns, "_id", "_rows")
    kept = runtime.written(minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias(rows)), "kept")
    of = docs.join(kept, F.col("doc_id") == F.col(key))
    once = of.where(F.col(rows) == 1).select(*docs.columns)
    if kept.where(F.col(rows) > 1).limit(1).count():
        once = once.unionByName(of.where(F.col(rows) > 1).select(*docs.columns).dropDuplicates(["doc_id"]))
    return once.unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window similar to a benchmark item go."""
    found = decontaminate.contamination(docs, runtime.table(spark, sf_dir, "benchmark"))
    (key,) = runtime.fresh(docs.columns, "_id")
    ids = runtime.written(found.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return docs.join(runtime.joined_side(ids), F.col("doc_id").eqNullSafe(F.col(key)), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = runtime.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = runtime.written(docs, name)
    return docs


#: SQL can't express a trained classifier.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
