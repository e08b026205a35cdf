"""The corpus pipeline: documents pass five stages, each written as Parquet and read again by the next.

Rejected documents go, near-duplicates keep one of each group, contaminated documents go, secrets are masked, and what
is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cutweave.llm.decontaminate import find_contamination
from cutweave.llm.jaccard_join import first_of_each, row_key
from cutweave.llm.packing import pack
from cutweave.llm.quality import THRESHOLD, fit_quality, score_quality
from cutweave.llm.secret_scan import mask_secrets
from cutweave.session import materialise

#: Near-duplicates here share 80 in 100 of their shingles of five words.
SHINGLE, PERCENT = 5, 80


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one struct, so that no column of it can meet a name that a stage uses."""
    return docs.select(F.struct("*").alias("row"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores at its threshold or more.

    Null and empty texts are scored like any other, by the bias. Repeated rows share their fate; an empty table gives an
    empty one; rows without an id are scored but not fitted on; columns keep their names and values.
    """
    weights = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(_whole(docs), weights, keep=["row"], text="row.text")
    return scored.where(F.col("score") >= THRESHOLD).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id, then the least hash of its text.

    Different texts of one id are different documents. Of rows that repeat both id and text one stays. Null and empty
    texts have no shingles and no near-duplicates. Rows without an id all stay, as a decision can't name them. An empty
    table gives an empty one; columns keep their names and values.
    """
    kept = first_of_each(docs, SHINGLE, PERCENT)
    numbered = _whole(docs).withColumn("n", F.monotonically_increasing_id())  # of a written table: the same in every scan
    told = F.xxhash64(*(F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind))
    keys = numbered.where("row.doc_id is not null").select(*row_key(docs, "row"), "n", told.alias("told"))
    first = keys.groupBy("id", "th").agg(F.min(F.struct("told", "n")).alias("first"))  # combines before the shuffle
    stay = first.join(kept, ["id", "th"], "left_semi").select(F.col("first.n").alias("n"))
    return numbered.join(stay, "n", "left_semi").select("row.*").union(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage contaminates.

    Null and empty texts have no words and stay, so do rows without an id. Repeated rows share their fate; an empty table
    gives an empty one; columns keep their names and values.
    """
    found = find_contamination(_whole(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["row"], text="row.text")
    return found.where("not contaminated").select("row.*")


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret found in their texts replaced by a mask.

    Texts without secrets, null and empty ones among them, and all columns but text and n_chars stay as they are. Repeated
    rows repeat; an empty table gives an empty one.
    """
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences.

    Null text is empty and makes a piece of the end id alone. Rows that repeat an id, or have none, are packed each; an
    empty table gives no pieces; columns other than doc_id and text are ignored.
    """
    return pack(docs)


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", mask), ("packing", packing)]

#: Training, hashing and tokenising are beyond SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
