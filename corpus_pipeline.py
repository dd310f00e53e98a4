"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as a table in the shared
folder, and hands on the columns of `documents`; the last one gives the packed
pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyloom.llm import decontamination, exact_dedup, language, near_dedup, packing
from copyloom.llm.common import fresh, share, stored, table
from copyloom.plans.skew import numbered

#: Rows, by id and digest, that may be broadcast; a larger set is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _sha256() -> Column:
    """Digest of a row's text as in `exact_dedup`; null counts as empty."""
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _with_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents that are (`left_semi`) or aren't (`left_anti`) among some `doc_id, text_sha256`; null equals null."""
    of_id, sha = fresh(docs, "_id", "_sha")
    rows = stored(rows.select(F.col("doc_id").alias(of_id), F.unhex("text_sha256").alias(sha)).distinct(), "rows")
    small = _small(rows)
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.unhex(_sha256()) == F.col(sha))
    return docs.join(small, same, how)


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that language identification rejects: no letters, or too low a score."""
    told = language.detected(docs, language.fit(docs))
    return told.where("lang_accepted").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the largest id, of each group with equal texts; ids count with their text.

    A row without an id stays only if no equal text has one. Of rows equal in id
    and text one stays; null and empty are equal.
    """
    found = stored(exact_dedup.exact_dedup(docs, share(6, F.col("doc_id")) < 0.5), "exact-copies")
    left = _with_rows(docs, found.where("not kept"), "left_anti")
    again = found.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = stored(again.select("doc_id", "text_sha256"), "repeated-rows")
    if again.isEmpty():
        return left
    # Whichever row: the stage's result is stored, so it stays the one.
    same = fresh(docs, "_same")[0]
    once = _with_rows(left, again, "left_semi").withColumn(same, F.coalesce("text", F.lit("")))
    once = once.dropDuplicates(["doc_id", same]).select(*docs.columns)
    return _with_rows(left, again, "left_anti").unionByName(once)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest id, of each component of near duplicates; rows without an id stay.

    Where texts share an id, rows are numbered in order of id and text, and the
    numbers take the place of the ids.
    """
    named = docs.where("doc_id is not null")
    rows = named.select("doc_id", _sha256().alias("text_sha256"))
    if named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        gone = near_dedup.near_dedup(docs).where("not kept").select("doc_id")
        return docs.join(_small(stored(gone, "near-copies")), "doc_id", "left_anti").select(*docs.columns)
    numbers = stored(numbered(rows.distinct(), [], ["doc_id", "text_sha256"], "number"), "numbers")
    texts = named.select("doc_id", "text", _sha256().alias("text_sha256")).join(numbers, ["doc_id", "text_sha256"])
    found = near_dedup.near_dedup(texts.select(F.col("number").alias("doc_id"), "text").dropDuplicates(["doc_id"]))
    gone = found.where("not kept").select(F.col("doc_id").alias("number"))
    return _with_rows(docs, numbers.join(gone, "number", "left_semi"), "left_anti")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmarks),
    ("packing", packed),
]

#: SQL has no expression for three of the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
