"""A corpus pipeline of five stages over `documents`.

Each stage is written as Parquet and reread as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.llm import decontaminate, language, minhash, packing, pii
from mediaspan.llm.keyed import by_marks, fresh, key_marks
from mediaspan.llm.queries import SURROGATE_KEY, TOKENIZER
from mediaspan.plans.workspace import Workspace

#: A document goes if less than this share of its letters is of its main language.
MIN_LANGUAGE_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, mainly of one learned language, stay.

    A null or empty text, or one without letters, goes. Repeated rows share
    their fate, rows without an id or a label are judged like others, and all
    columns stay whatever their names. Without labelled rows all documents go.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    by_name = {n.lower(): F.col(f"c{i}") for i, n in enumerate(names)}
    model = language.learn(spark, docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(spark, inner, model, text=f"c{[n.lower() for n in names].index('text')}")
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return kept.select(*[by_name[n.lower()].alias(n) for n in names])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the smallest id stays.

    Null and empty texts are like nothing and stay, as do rows without an id.
    Rows that repeat an id go or stay together.
    """
    work = Workspace(spark, "near-dedup")
    groups = minhash.minhash_groups(spark, docs)
    out_id = fresh(docs.columns, "gone_id")
    gone = work.table(groups.where("not kept and doc_id is not null").select(F.col("doc_id").alias(out_id)).distinct(), "gone")
    maybe, others = by_marks(docs, F.col("doc_id"), key_marks(gone, out_id, work, "marks"))
    return maybe.join(gone, F.col("doc_id") == F.col(out_id), "left_anti").unionByName(others)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item stay.

    Null and empty texts have no words and stay, as does every row if the
    benchmark is empty. Repeated rows share their fate.
    """
    return decontaminate.without_benchmark(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in the texts get surrogates; every row stays.

    Null and empty texts stay as they are, repeated rows are replaced alike.
    n_chars, if there, becomes the length of the new text, null for a null one.
    """
    safe = pii.pseudonymise(spark, docs, SURROGATE_KEY)
    counted = {f.name: f.dataType for f in docs.schema if f.name.lower() == "n_chars"}
    for name, kind in counted.items():
        safe = safe.withColumn(name, F.length("text").cast(kind))
    return safe


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048.

    A null or empty text is a document of the end id alone; repeated rows are
    packed as often as they occur; other columns are left behind.
    """
    return packing.pack(spark, docs, TOKENIZER)


STAGES = [("language", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", surrogates), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs
