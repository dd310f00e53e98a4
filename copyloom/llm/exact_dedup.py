"""Exact duplicates: static filters over a snapshot, exact buckets, byte comparison.

A snapshot is immutable: its distinct digests with their groups, dealt to
buckets by hash, and one binary-fuse filter per bucket. Incoming digests are
first grouped among themselves; the filter of their bucket then tells most new
ones apart at about one byte per stored digest, and only what passes it is
joined with the exact buckets. Texts are compared byte by byte wherever a digest
has more than one document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import ship, stored

#: Digests per bucket, which one task holds.
PER_BUCKET = 50_000

#: Digests that may be broadcast: 32 bytes each, some 50 MB as a hash table.
BROADCAST_ROWS = 500_000


# --- binary-fuse filter -------------------------------------------------------------


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _cells(h: np.ndarray, segment: int, starts: int) -> np.ndarray:
    """Three cells per key, in three segments that follow each other."""
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(starts)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third], axis=1).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Unsigned 64-bit keys → `seed, segment, starts, cells` of a static filter.

    All keys whose cell no other key touches are peeled off at once, round by
    round; in reverse order each gets its print written to that cell.
    """
    keys = np.unique(keys)
    n = len(keys)
    if not n:
        return 0, 4, 0, b""
    segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
    starts = max(1, math.ceil(n * factor / segment) - 2) * segment
    cells = starts + 2 * segment
    for seed in range(1, 1000):
        h = _mixed(keys, seed)
        at = _cells(h, segment, starts)
        touched = np.bincount(at.ravel(), minlength=cells)
        owner = np.bincount(at.ravel(), np.repeat(np.arange(n, dtype=float), 3), minlength=cells)
        rounds = []
        left = n
        while left:
            alone = np.flatnonzero(touched == 1)
            peeled, place = np.unique(owner[alone].astype(np.int64), return_index=True)
            if not len(peeled):
                break
            rounds.append((peeled, alone[place]))
            gone = at[peeled].ravel()
            touched -= np.bincount(gone, minlength=cells)
            owner -= np.bincount(gone, np.repeat(peeled.astype(float), 3), minlength=cells)
            left -= len(peeled)
        if not left:
            out, prints = np.zeros(cells, np.uint8), _prints(h)
            for peeled, place in reversed(rounds):
                out[place] = prints[peeled] ^ np.bitwise_xor.reduce(out[at[peeled]], axis=1)
            return seed, segment, starts, out.tobytes()
    raise RuntimeError("no seed separates the keys")


def in_filter(keys: np.ndarray, seed: int, segment: int, starts: int, cells: bytes) -> np.ndarray:
    """Whether keys may be among those of a filter; true for all that are."""
    if not cells:
        return np.zeros(len(keys), bool)
    h = _mixed(keys, seed)
    found = np.frombuffer(cells, np.uint8)[_cells(h, segment, starts)]
    return np.bitwise_xor.reduce(found, axis=1) == _prints(h)


# --- snapshots ----------------------------------------------------------------------


@dataclass
class Snapshot:
    """Distinct digests of earlier documents (`digest, keep_id, n`), with a filter per bucket."""

    entries: DataFrame
    filters: DataFrame
    buckets: int


def text_digests(docs: DataFrame) -> DataFrame:
    """`doc_id, digest`: SHA-256 of the text; null counts as empty."""
    return docs.select("doc_id", _digest().alias("digest"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def grouped(digests: DataFrame) -> DataFrame:
    """One row per digest, reduced before the shuffle: `digest, keep_id` (largest), `n`."""
    return digests.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )


def build_snapshot(digests: DataFrame) -> Snapshot:
    """An immutable snapshot of `doc_id, digest`."""
    ship(digests.sparkSession)
    entries = stored(grouped(digests), "snapshot")
    buckets = max(1, math.ceil(entries.count() / PER_BUCKET))

    def build(keys: pd.DataFrame) -> pd.DataFrame:
        made = build_filter(keys["key"].to_numpy().view(np.uint64))
        return pd.DataFrame([(int(keys["bucket"].iloc[0]), *made)], columns=columns)

    columns = ["bucket", "seed", "segment", "starts", "cells"]
    filters = (
        _keyed(entries, buckets)
        .select("bucket", "key")
        .groupBy("bucket")
        .applyInPandas(build, "bucket bigint, seed bigint, segment bigint, starts bigint, cells binary")
    )
    return Snapshot(entries, stored(filters, "snapshot-filters"), buckets)


def _keyed(entries: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64("digest")
    return entries.withColumns({"key": key, "bucket": F.pmod(key, F.lit(buckets)).cast("bigint")})


def screened(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Those rows of `digest, keep_id, n` that may be in the snapshot.

    A large batch deals each bucket to several tasks, each with a copy of its filter.
    """
    parts = max(1, math.ceil(batch.count() / (snapshot.buckets * PER_BUCKET)))
    rows = _keyed(batch, snapshot.buckets).withColumn(
        "part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("bigint")
    )
    filters = snapshot.filters.withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))
    )

    def screen(one: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        kept = some[["digest", "keep_id", "n"]]
        if one.empty or some.empty:
            return kept.iloc[:0]
        f = one.iloc[0]
        keys = some["key"].to_numpy().view(np.uint64)
        return kept[in_filter(keys, int(f.seed), int(f.segment), int(f.starts), f.cells)]

    return (
        filters.groupBy("bucket", "part")
        .cogroup(rows.groupBy("bucket", "part"))
        .applyInPandas(screen, "digest binary, keep_id bigint, n bigint")
    )


# --- decisions ----------------------------------------------------------------------


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where the counted size allows it; otherwise left to a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def exact_dedup(docs: DataFrame, earlier: Column) -> DataFrame:
    """Groups of equal texts: `doc_id, keep_id, group_size, kept, text_sha256`, one row per row.

    `earlier` tells the rows of the snapshot from the incoming batch; the result
    is the same wherever that line is drawn. The row with the largest doc_id of
    a group stays. A null text is empty; null ids count as smaller than others,
    and rows that repeat the id of the one that stays, stay with it. An empty
    table gives no rows; other columns don't matter.
    """
    rows = stored(
        docs.select("doc_id", _digest().alias("digest"), F.coalesce(earlier, F.lit(False)).alias("earlier")),
        "digests",
    )
    snapshot = build_snapshot(rows.where("earlier"))
    batch = stored(grouped(rows.where(~F.col("earlier"))), "batch")
    matched = screened(batch, snapshot).alias("b").join(snapshot.entries.alias("s"), "digest")
    across = stored(
        matched.select(
            "digest",
            F.greatest("b.keep_id", "s.keep_id").alias("keep_id"),
            (F.col("b.n") + F.col("s.n")).alias("n"),
        ),
        "matched",
    )
    within = batch.where("n > 1").unionByName(snapshot.entries.where("n > 1"))
    groups = stored(
        within.join(across, "digest", "left_anti").unionByName(across).select("digest", "keep_id", "n"),
        "groups",
    )
    count = groups.count()
    # The byte comparison: grouping by the text itself, which reduces copies where they are read.
    repeated = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _digest().alias("digest")).join(
        _small(groups.select("digest"), count), "digest", "left_semi"
    )
    collided = stored(
        repeated.groupBy("digest", "text")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("texts"))
        .where("texts > 1")
        .select("digest"),
        "collided",
    )
    n_collided = collided.count()
    decided = rows.join(_small(groups, count), "digest", "left")
    if n_collided:
        unequal = repeated.join(collided, "digest", "left_semi")
        by_text = unequal.groupBy("digest", "text").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")
        )
        decided = decided.join(collided, "digest", "left_anti").select(
            "doc_id", "digest", "keep_id", "n"
        ).unionByName(
            unequal.join(by_text, ["digest", "text"]).select("doc_id", "digest", "keep_id", "n")
        )
    grouped_by_copy = F.col("n").isNotNull()
    keep_id = F.when(grouped_by_copy, F.col("keep_id")).otherwise(F.col("doc_id"))
    return decided.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
