"""Corpus preparation: stages over the documents table, each written and read again.

language id            documents in no known language go
near copies            one document of each class of copies and near copies stays
decontamination        documents that hold a benchmark item go
secrets                secrets are replaced by a mark
packing                token ids of what is left, packed into windows by source

The first four return the columns of their input, extra columns of any name included; null ids
and repeated rows are kept or dropped by their texts alone; null and empty texts go in the first
stage, as they have no language. Each stage is a function of (spark, docs, sf_dir).
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, language_id, mixture_pack, neardup, secrets
from spanloom.llm.common import crc_mod, discard, materialise, scratch

#: Texts of unknown language, or that fit their language this badly, are rejected.
LEAST_LANGUAGE_SCORE = 0.2
#: Numbers of rows to drop are broadcast, through the driver, up to this many, and joined by a shuffle beyond.
BROADCAST_ROWS = 100_000
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _whole_rows(stage):
    """Gives other columns than those of the documents neutral names while the stage runs."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = [c if c in KNOWN else f"__extra{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*inner), sf_dir).select(*inner).toDF(*docs.columns)

    return run_stage


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number __row that tells rows apart: doc_id where that does, else one given here.

    Numbers that are given are written with the rows, as they would not be the same again.
    """
    n, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n == ids:
        return docs.withColumn("__row", F.col("doc_id").cast("long"))
    return materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "stage", "lz4")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows without those whose __row is in gone, a written table; that is broadcast if it is small, and never if not."""
    small = gone.count() <= BROADCAST_ROWS
    return rows.join(gone.hint("broadcast" if small else "shuffle_merge"), "__row", "left_anti")


@_whole_rows
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(crc_mod("doc_id", 4) != 2))
    found = language_id.identify(docs, model, docs.columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


@_whole_rows
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the row with the least number stays: the least doc_id, if ids tell rows apart."""
    rows = _numbered(docs)
    classes = neardup.near_copies(rows.select("__row", "text"), id_col="__row")
    # A class is named by its least row number, so that row is the one that stays.
    gone = materialise(classes.where("id != class_id").select(F.col("id").alias("__row")), "gone")
    return _without(rows, gone).select(*docs.columns)


@_whole_rows
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontaminate.leaks(rows.select("__row", "text"), items, id_col="__row").select(F.col("id").alias("__row")).distinct()
    return _without(rows, materialise(leaks, "leaks")).select(*docs.columns)


@_whole_rows
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their secrets; n_chars is counted again where a text has changed."""
    out = secrets.redact(docs, secrets.train(docs))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture_pack.pack(docs)


STAGES = [("language id", language), ("near copies", near_copies), ("decontamination", decontamination), ("secrets", secret_scan), ("packing", packing)]
#: Language models, signatures and token ids are not in SQL's reach; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with scratch(spark) as keep:  # what a stage has written goes with it
            docs = materialise(stage(spark, docs, sf_dir), "documents")
            keep.add(docs.scratch)
        if path:
            discard(spark, path)
        path = docs.scratch
    return docs
