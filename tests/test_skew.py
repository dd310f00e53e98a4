import random

import pytest
from pyspark.sql import functions as F

from copyloom.plans import skew


@pytest.fixture
def many_pieces(spark):
    """Small inputs would be merged into one partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbered_with_a_hot_group(spark, many_pieces):
    rng = random.Random(1)
    rows = [("hot", i) for i in range(6000)] + [(f"g{i % 700}", i) for i in range(3000)] + [(None, 1), (None, 5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int").repartition(7)
    got = skew.numbered(df, ["g"], ["o"])
    assert got.columns == ["g", "o", "seq"]
    want = {}
    for g, o in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want.setdefault(g, []).append(o)
    seen = {}
    for r in got.collect():
        seen.setdefault(r.g, {})[r.seq] = r.o
    assert seen == {g: dict(enumerate(os, 1)) for g, os in want.items()}


def test_hot_group_is_cut_into_pieces(spark, many_pieces):
    df = spark.range(20000).select(F.lit("hot").alias("g"), F.col("id").alias("o"))
    placed = df.repartitionByRange("g", "o").groupBy(F.spark_partition_id()).count().collect()
    assert len(placed) > 1


def test_numbered_over_everything(spark, many_pieces):
    df = spark.range(5000).select((F.lit(5000) - F.col("id")).alias("o")).repartition(9)
    assert sorted((r.o, r.seq) for r in skew.numbered(df, [], ["o"]).collect()) == [(i, i) for i in range(1, 5001)]


def test_concat_in_order_over_blocks(spark):
    rows = [("a", i, f"<{i}>") for i in range(3000)] + [("b", 2, "y"), ("b", 1, "x"), ("c", 5000, "z")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, seq long, text string").repartition(5)
    got = {r.k: (r.text, r.n) for r in skew.concat_in_order(df, ["k"], "seq", "text", block=100).collect()}
    assert got == {"a": ("".join(f"<{i}>" for i in range(3000)), 3000), "b": ("xy", 2), "c": ("z", 1)}


def lookup_case(spark, join):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 40}", i) for i in range(200)] + [("none", 1), (None, 2)]
    big = spark.createDataFrame(rows, "k string, n int")
    small = spark.createDataFrame([("hot", "H"), *[(f"k{i}", f"V{i}") for i in range(40)]], "k string, v string")
    want = dict(small.collect())
    for how in ("left", "inner"):
        got = sorted(((r.k or "", r.n, r.v or "") for r in join(big, small, how).collect()))
        expected = sorted((k or "", n, want.get(k) or "") for k, n in rows if how == "left" or k in want)
        assert got == expected


def test_salted_lookup(spark):
    lookup_case(spark, lambda b, s, how: skew.salted_lookup(b, s, "k", how))
