"""Placement on shards by a lookup table in which shards took turns claiming slots.

Each shard has its own order of preference over the slots of a prime-sized
table; in turn, each claims the first free slot it likes best, so that shares
differ by one slot at most, and a shard that comes or goes moves few slots but
its own. Placing a row is a hash and a look into the broadcast table, of fixed
size. Only DataFrame functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots: a prime, and at least a hundred times as many as there are shards.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_slots(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the number of its shard; depends on the shards' names and their order.

    A shard prefers the slots `offset + k * skip`, both from hashes of its name;
    as the number of slots is prime, that is a permutation of them.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards have to have different names, and there has to be one")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots has to be a prime, no less than the number of shards")

    def number(kind: str, name: str) -> int:
        return int.from_bytes(hashlib.sha256(f"{kind}:{name}".encode()).digest()[:8], "big")

    wish = [number("offset", s) % slots for s in shards]
    skip = [number("skip", s) % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    left = slots
    while True:
        for i in range(len(shards)):
            at = wish[i]
            while owner[at] >= 0:
                at = (at + skip[i]) % slots
            owner[at] = i
            wish[i] = (at + skip[i]) % slots
            left -= 1
            if not left:
                return owner


def slot_table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """`slot, shard`: one row per slot."""
    owner = ",".join(map(str, fill_slots(shards, slots)))
    names = F.array(*map(F.lit, shards))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(owner), ",")).alias("slot", "no"))
    return rows.select("slot", names[F.col("no").cast("int")].alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 15 hex digits of the MD5 of its text, modulo the slots; null counts as empty."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
    return F.pmod(number, F.lit(slots)).cast("int")


def placed(rows: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """All columns of `rows` with `slot` and `shard`; columns of these names are replaced.

    Equal keys go to one shard, null ones too; an empty table stays empty.
    Nothing is shuffled: the table has `slots` rows, whatever the data.
    """
    rows = rows.drop(*[c for c in ("slot", "shard") if c != key])
    table = slot_table(rows.sparkSession, shards, slots)
    joined = rows.join(F.broadcast(table), slot_of(rows[key], slots) == table["slot"])
    return joined.select(*[rows[c] for c in rows.columns], table["slot"], table["shard"])


def write_shards(rows: DataFrame, key: str, shards: Sequence[str], path: str, files: int = 8) -> None:
    """Placed rows as one folder per shard, each written by up to `files` tasks.

    A key that holds most rows is spread over the files of its shard by the
    values of its rows.
    """
    placing = placed(rows, key, shards)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(files))
    placing.repartition(F.col("shard"), spread).write.partitionBy("shard").parquet(path)
