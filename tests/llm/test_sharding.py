import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from copyloom.llm import sharding
from tests.llm import odd_rows

NAMES = [f"s{i}" for i in range(7)]


def plain(names, slots):
    """By whole lists of preference."""

    def number(kind, name):
        return int.from_bytes(hashlib.sha256(f"{kind}:{name}".encode()).digest()[:8], "big")

    wishes = [
        [(number("offset", n) % slots + k * (number("skip", n) % (slots - 1) + 1)) % slots for k in range(slots)] for n in names
    ]
    assert all(sorted(w) == list(range(slots)) for w in wishes)
    owner = {}
    while len(owner) < slots:
        for i, wish in enumerate(wishes):
            if len(owner) < slots:
                owner[next(s for s in wish if s not in owner)] = i
    return [owner[s] for s in range(slots)]


@pytest.mark.parametrize("slots", [7, 11, 101, 211])
def test_slots_against_plain(slots):
    assert sharding.fill_slots(NAMES, slots) == plain(NAMES, slots)


def test_even_and_steady():
    before = sharding.fill_slots(NAMES)
    shares = Counter(before)
    assert max(shares.values()) - min(shares.values()) <= 1
    after = sharding.fill_slots(NAMES[:-1])
    moved = sum(a != b for a, b in zip(before, after) if b is not None and a != 6)
    assert moved < 0.1 * sharding.SLOTS
    for names, slots in ([], 11), (["a", "a"], 11), (["a"], 12), (NAMES, 5):
        with pytest.raises(ValueError):
            sharding.fill_slots(names, slots)


def test_rows(spark):
    docs = odd_rows.docs(spark).withColumn("slot", F.col("hash"))
    placed = sharding.placed(docs, "doc_id", NAMES, 101)
    assert placed.columns == [*odd_rows.docs(spark).columns, "slot", "shard"]
    got = placed.collect()
    assert len(got) == len(odd_rows.ROWS)
    owner = sharding.fill_slots(NAMES, 101)
    for r in got:
        text = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r.shard) == (slot, NAMES[owner[slot]])
    assert sharding.placed(odd_rows.empty(spark), "doc_id", NAMES).collect() == []
    assert "BroadcastHashJoin" in placed._jdf.queryExecution().executedPlan().toString()


def test_written_shards(spark):
    from copyloom.plans.workdir import new_path

    path = new_path(spark, "shards")
    sharding.write_shards(odd_rows.docs(spark), "doc_id", NAMES, path)
    back = spark.read.parquet(path)
    assert back.count() == len(odd_rows.ROWS)
    assert math.isclose(back.groupBy("doc_id").agg({"shard": "count"}).count(), len({r[0] for r in odd_rows.ROWS}))
