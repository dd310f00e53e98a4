"""A store of known links that grows by numbered increments.

Links lie in buckets by hash, each increment in a folder per bucket. With every
increment goes a small filter per bucket, a bitmap in which each link sets two
bits. A crawl looks its links up in the filters first, and reads the known links
only of buckets where a filter says that one may be there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyloom.plans.workdir import new_path
from copyloom.sources import commit_log

#: Bits of a filter: what one bitmap of Spark's bitmap functions has.
BITS = 32_768
#: Buckets of a store at most; a crawl gives as many numbers to the driver.
MOST_BUCKETS = 65_536

_LINKS = "link string, increment string, bucket int"
_FILTERS = "bucket int, bitmap binary, increment string"


def create(spark: SparkSession, folder: str, buckets: int = 256) -> None:
    """A store without links; best with a bucket for every 4,000 links that it will hold.

    With more links in a bucket filters rule out less, so that more is read; the
    results are the same.
    """
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"from 1 to {MOST_BUCKETS} buckets")
    commit_log.commit(spark, folder, 0, {"buckets": buckets})


def _keyed(links: DataFrame, buckets: int) -> DataFrame:
    bits = [F.pmod(F.xxhash64("link", F.lit(seed)), F.lit(BITS)).cast("int") for seed in (1, 2)]
    return links.select(
        "link", F.pmod(F.xxhash64("link"), F.lit(buckets)).cast("int").alias("bucket"), F.array(*bits).alias("bits")
    )


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1


def _increments(log: dict[int, dict]) -> list[str]:
    return [e["increment"] for e in log.values() if e.get("increment")]


def known(spark: SparkSession, folder: str, buckets: list[int] | None = None) -> DataFrame:
    """`link, increment, bucket` of committed increments; of some buckets only, whose folders alone are read."""
    names = _increments(commit_log.entries(spark, folder))
    if not names:
        return spark.createDataFrame([], _LINKS)
    held = spark.read.schema(_LINKS).parquet(f"{folder.rstrip('/')}/links").where(F.col("increment").isin(names))
    return held if buckets is None else held.where(F.col("bucket").isin(buckets))


def asked(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """Distinct links of `found`: `link, bucket, maybe`, the last one false where the filters rule it out."""
    log = commit_log.entries(spark, folder)
    keyed = _keyed(found.select("link").where("link is not null").distinct(), log[0]["buckets"])
    names = _increments(log)
    if not names:
        return keyed.select("link", "bucket", F.lit(False).alias("maybe"))
    filters = spark.read.schema(_FILTERS).parquet(f"{folder.rstrip('/')}/filters").where(F.col("increment").isin(names))
    # One row per bucket, of 4 kB.
    whole = filters.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    maybe = F.forall("bits", lambda b: _is_set(F.col("bitmap"), b))
    return keyed.join(whole, "bucket", "left").select("link", "bucket", F.coalesce(maybe, F.lit(False)).alias("maybe"))


def news(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """Links of `found` that the store does not have, each once: `link, bucket`."""
    path = new_path(spark, "asked-links")
    asked(spark, folder, found).write.parquet(path)
    told = spark.read.schema("link string, bucket int, maybe boolean").parquet(path)
    fired = [r["bucket"] for r in told.where("maybe").select("bucket").distinct().collect()]  # as many as buckets
    new = told.where("not maybe").select("link", "bucket")
    if not fired:
        return new
    there = known(spark, folder, fired).select("link", "bucket")
    return new.unionByName(told.where("maybe").select("link", "bucket").join(there, ["bucket", "link"], "left_anti").select("link", "bucket"))


def add(spark: SparkSession, folder: str, found: DataFrame, batch: str, tries: int = 5) -> DataFrame:
    """Put the news of a crawl into the store as its next increment; gives them (`link`).

    `batch` names the crawl: one that has been put in before changes nothing and
    gives the news it had then. If another crawl is put in meanwhile, the news
    are found anew. Null links are left out; links found twice count once.
    """
    root = folder.rstrip("/")
    for _ in range(tries):
        log = commit_log.entries(spark, folder)
        done = next((e for e in log.values() if e.get("batch") == batch), None)
        if done:
            return known(spark, folder).where(F.col("increment") == done["increment"]).select("link")
        name = uuid.uuid4().hex
        here = f"{root}/links/increment={name}"
        news(spark, folder, found).repartition("bucket").write.partitionBy("bucket").parquet(here)
        written = spark.read.schema("link string, bucket int").parquet(here)
        set_bits = _keyed(written, log[0]["buckets"]).select("bucket", F.explode("bits").alias("bit"))
        filters = set_bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        filters.write.parquet(f"{root}/filters/increment={name}")
        try:
            commit_log.commit(spark, folder, max(log) + 1, {"batch": batch, "increment": name})
        except commit_log.Conflict:
            continue
        return written.select("link")
    raise commit_log.Conflict(f"{folder}: other crawls were first {tries} times")
