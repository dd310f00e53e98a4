"""Page facts stored once in buckets by address, for joins that read them where they lie.

The rows of a bucket are sorted by address. A join on the address then shuffles
only the narrow parts of requests; titles and texts go from the store straight
into the rows that need them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copyloom.operators.bundle import attach_facts
from copyloom.plans.workdir import new_path
from copyloom.sources import commit_log

#: A bucket is read by one task. An address with more parts than this, and more than a
#: thousandth of all, is popular; there are fewer than a thousand such addresses.
POPULAR_ROWS, POPULAR_SHARE = 10_000, 0.001
#: Bytes of popular facts that may be broadcast; adaptive execution splits the join beyond.
BROADCAST_BYTES = 64 << 20


def write_facts(facts: DataFrame, folder: str, buckets: int | None = None) -> str:
    """Facts, unique on `url`, into a new store; gives its folder.

    As many buckets as the session has shuffle partitions unless told otherwise:
    a bucket should fit a task. A folder that already holds a store is refused.
    """
    spark = facts.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if commit_log.entries(spark, folder):
        raise commit_log.Conflict(f"{folder} holds facts already")
    table = f"facts_{uuid.uuid4().hex}"
    data = f"{folder.rstrip('/')}/{table}"
    # Dealt like the buckets, so that a task writes one file.
    dealt = facts.repartition(buckets, "url")
    dealt.write.format("parquet").bucketBy(buckets, "url").sortBy("url").option("path", data).saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: the data are not the catalog's
    commit_log.commit(spark, folder, 0, {"table": table, "buckets": buckets, "schema": facts.schema.jsonValue()})
    return folder


def _entry(spark: SparkSession, folder: str) -> tuple[str, int, T.StructType]:
    log = commit_log.entries(spark, folder)
    if not log.get(0):
        raise FileNotFoundError(f"no facts in {folder}")
    return log[0]["table"], log[0]["buckets"], T.StructType.fromJson(log[0]["schema"])


def read_facts(spark: SparkSession, folder: str) -> DataFrame:
    """All facts, in their buckets; the store is known to the session's catalog from then on."""
    table, buckets, schema = _entry(spark, folder)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        place = json.dumps(f"{folder.rstrip('/')}/{table}")
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet"
            f" CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS LOCATION {place}"
        )
    return spark.table(table)


def _dealt_anew(spark: SparkSession, folder: str) -> DataFrame:
    """All facts as plain files, whose joins adaptive execution may split."""
    table, _, schema = _entry(spark, folder)
    return spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{table}")


def attached(parts: DataFrame, folder: str) -> DataFrame:
    """`attach_facts` with the facts of a store, which are not shuffled.

    The parts, four narrow columns, are stored first and counted by address. Those
    of popular addresses, and those without one, would meet in one bucket's task;
    they are joined apart, with the facts of these addresses alone.
    """
    spark = parts.sparkSession
    path = new_path(spark, "parts")
    parts.write.parquet(path)
    held = spark.read.schema(parts.schema).parquet(path)
    counts = held.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    least = max(POPULAR_ROWS, POPULAR_SHARE * held.count())
    popular = [r["url"] for r in counts.where(F.col("url").isNotNull() & (F.col("n") > least)).collect()]
    facts = read_facts(spark, folder)
    own = _dealt_anew(spark, folder).where(F.col("url").isin(popular))
    size = own.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first()["n"] or 0
    apart = F.col("url").isNull() | F.col("url").isin(popular)
    return attach_facts(held.where(~apart), facts).unionByName(
        attach_facts(held.where(apart), F.broadcast(own) if size <= BROADCAST_BYTES else own)
    )
