import datetime
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from copyloom.functions import text as tx
from copyloom.operators import history as hist

RECORD = "domain string, brand_name string, version long"


def test_parse(spark):
    rows = [('[{"domain":"a","keywords_pool":["x"]},{"domain":"b"}]',), ('[{"domain":"a"',), (None,), ("[]",), ("oops",)]
    df = spark.createDataFrame(rows, "t string").select(hist.parse_history(F.col("t")).alias("h"))
    assert [len(r.h) for r in df.collect()] == [2, 0, 0, 0, 0]
    assert df.first().h[0].keywords_pool == ["x"]


def test_upsert_and_order(spark):
    history = spark.createDataFrame([("a", "A", 1, 1), ("b", "B", 5, 2)], RECORD + ", first_saved long")
    records = spark.createDataFrame([("c", "C1", 6), ("a", "A2", 7), ("c", "C2", 8)], RECORD)
    got = hist.upsert(history, records).orderBy(F.desc("first_saved")).collect()
    assert [(r.domain, r.brand_name) for r in got] == [("c", "C2"), ("b", "B"), ("a", "A2")]


def test_fill(spark):
    fields = "domain string, brand_name string, target_market string, competitor_urls string, brand_info string"
    requests = spark.createDataFrame([("a", "typed", "tm", "cu", "bi", "keep"), ("z", "typed", "tm", "cu", "bi", "keep")], fields + ", keywords string")
    history = spark.createDataFrame([("a", "stored", "", None, "info", ["k"])], fields + ", keywords_pool array<string>")
    got = {r.domain: r for r in hist.fill_from_history(requests, history).collect()}
    a, z = got["a"], got["z"]
    assert (a.brand_name, a.target_market, a.competitor_urls, a.brand_info, a.keywords) == ("stored", "tm", "cu", "info", "keep")
    assert (a.keywords_pool, a.matched) == (["k"], True)
    assert (z.brand_name, z.keywords_pool, z.matched) == ("typed", [], False)


def test_edits(spark):
    history = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", ["q"]), ("c", None)], "domain string, keywords_pool array<string>")
    edits = spark.createDataFrame(
        [
            ("a", 5, 0, "set", " again "), ("a", 1, 0, "set", " new "), ("a", 2, 2, "delete", None),
            ("a", 3, 9, "delete", None), ("a", 4, 0, "delete", None), ("a", 6, None, "delete", None),
            ("a", 7, -1, "delete", None), ("c", 1, 0, "set", "n"), ("unknown", 1, 0, "set", "n"),
        ],
        "domain string, edit_no int, pos int, op string, value string",
    )
    got = {r.domain: r.keywords_pool for r in hist.edit_pools(history, edits).collect()}
    assert got == {"a": ["again"], "b": ["q"], "c": []}


def folded(pool, edits):
    for pos, op, value in edits:
        if pos < len(pool):
            pool = [*pool[:pos], *([] if op == "delete" else [value]), *pool[pos + 1 :]]
    return pool


def some_edits(rng, n, size):
    kind = lambda: rng.choice(["set"] * 20 + ["delete"])
    return [(rng.randrange(size + 5), kind(), f"v{i}") for i in range(n)]


def test_scripts_against_a_fold():
    rng = random.Random(3)
    for _ in range(300):
        size = rng.randint(0, 12)
        pool = [f"w{i}" for i in range(size)]
        parts = [some_edits(rng, rng.randint(0, 25), size) for _ in range(3)]
        a, b, c = (hist.script_of(p, size) for p in parts)
        left = hist.joined_scripts(hist.joined_scripts(a, b, size), c, size)
        right = hist.joined_scripts(a, hist.joined_scripts(b, c, size), size)
        want = folded(pool, [e for p in parts for e in p])
        for gone, places, words in (left, right):
            assert len(gone) <= size and len(places) <= size
            out = dict(enumerate(pool)) | dict(zip(places.tolist(), words))
            assert [w for i, w in sorted(out.items()) if i not in gone.tolist()] == want


def test_a_long_log(spark):
    rng = random.Random(4)
    size, hot = 3000, some_edits(rng, 100_000, 3000)
    few = some_edits(rng, 40, 6)
    rows = [("hot", i, *e) for i, e in enumerate(hot)] + [("few", i, *e) for i, e in enumerate(few)]
    rng.shuffle(rows)
    pools = {"hot": [f"w{i}" for i in range(size)], "few": list("abcdef"), "none": ["x"]}
    history = spark.createDataFrame(list(pools.items()), "domain string, keywords_pool array<string>")
    edits = spark.createDataFrame(pd.DataFrame(rows, columns=["domain", "edit_no", "pos", "op", "value"]))
    got = {r.domain: r.keywords_pool for r in hist.edit_pools(history, edits).collect()}
    assert got == {"hot": folded(pools["hot"], hot), "few": folded(pools["few"], few), "none": ["x"]}
    none = hist.edit_pools(history, edits.where("domain = 'nobody'"))
    assert {r.domain: r.keywords_pool for r in none.collect()} == pools


def sorted_batches(rows, size, batch):
    """Edits of one domain after the other as a partition has them, in batches."""
    columns = list(zip(*[(d, size, pos, op, value) for d, pos, op, value in rows]))
    whole = pa.table(dict(zip(("domain", "size", "pos", "op", "value"), columns)))
    return whole.to_batches(max_chunksize=batch)


def test_partitions_fold_what_they_read():
    """A domain of 40,000 edits in three partitions: one script each, of no more entries than the pool has words."""
    rng = random.Random(5)
    size, hot = 500, some_edits(rng, 40_000, 500)
    others = {f"z{i}": some_edits(rng, 3, 500) for i in range(50)}
    rows = [("hot", *e) for e in hot] + [(d, *e) for d, es in sorted(others.items()) for e in es]
    cuts = [0, 15_000, 30_000, len(rows)]
    found = [
        r
        for part, (a, b) in enumerate(zip(cuts, cuts[1:]))
        for batch in hist.folded_runs(iter(sorted_batches(rows[a:b], size, 999)), part)
        for r in batch.to_pylist()
    ]
    pieces = [r for r in found if r["domain"] == "hot"]
    assert [(r["block"], r["edge"]) for r in pieces] == [(0, True), (1, True), (2, True)]
    assert [r["domain"] for r in found if r["edge"]] == ["hot"] * 3 + [max(others)]
    assert all(len(r["gone"]) + len(r["places"]) <= 2 * size for r in found)
    scripts = {}
    for r in found:
        script = (np.array(r["gone"], np.int64), np.array(r["places"], np.int64), r["words"])
        scripts[r["domain"]] = hist.joined_scripts(scripts[r["domain"]], script, size) if r["domain"] in scripts else script
    pool = [f"w{i}" for i in range(size)]
    assert scripts.keys() == {"hot", *others}
    for domain, (gone, places, words) in scripts.items():
        out = dict(enumerate(pool)) | dict(zip(places.tolist(), words))
        assert [w for i, w in sorted(out.items()) if i not in set(gone.tolist())] == folded(pool, hot if domain == "hot" else others[domain])
    assert not list(hist.folded_runs(iter([]), 0))


def test_scripts_on_arrays():
    """Pools of several slices, some without a script, are edited in Arrow arrays as a fold does."""
    rng = random.Random(6)
    pools, scripts, want = [], [], []
    for n in range(600):
        size = rng.randint(0, 30)
        pool, edits = [f"é{n}.{i}" if i % 7 else None for i in range(size)], some_edits(rng, rng.randint(0, 40), size)
        plain = n % 5 == 0
        scripts.append((None, None, None) if plain else hist.script_of(edits, size))
        pools.append(None if plain else pool)
        want.append(None if plain else folded(pool, edits))
    types = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
    columns = [pa.array([None if v is None else list(v) for v in c], t) for c, t in zip(zip(*scripts), types)]
    assert hist.edited(pa.array(pools, pa.list_(pa.string())), *columns).to_pylist() == want
    none = hist.edited(*[pa.array([], t) for t in (pa.list_(pa.string()), *types)])
    assert none.type == pa.list_(pa.string()) and len(none) == 0


def test_records_of_forms(spark):
    forms = spark.createDataFrame(
        [("https://W.example/x", "B", ["u1", "u2"], 1), ("", "B", [], 2)],
        "website_url string, brand_name string, competitor_urls array<string>, version long",
    ).select(
        "*", F.lit("m").alias("target_market"), F.lit(None).cast("array<string>").alias("keywords_pool"),
        F.lit("i").alias("brand_info"), F.timestamp_seconds(F.lit(86399)).alias("saved_at"),
    )
    rows = hist.record_of(forms).collect()
    assert len(rows) == 1
    assert (rows[0].domain, rows[0].competitor_urls, rows[0].keywords_pool) == ("w.example", "u1\nu2", [])
    assert rows[0].last_updated == datetime.date(1970, 1, 1)


def test_delete(spark):
    history = spark.createDataFrame([("a",), ("b",)], "domain string")
    assert [r.domain for r in hist.delete_records(history, history.where("domain = 'a'")).collect()] == ["b"]


def test_override_text(one):
    assert one(tx.override_text(F.col("s")), s=" a\n") == "a"
    assert one(tx.override_text(F.col("s")), s=" \n ") is None


def test_delete_by_place(spark):
    rows = [("a", 3), ("b", 9), ("c", 5)]
    history = spark.createDataFrame(rows, "domain string, first_saved long")
    places = spark.createDataFrame([(0,), (7,)], "pos int")
    assert sorted(r.domain for r in hist.delete_positions(history, places).collect()) == ["a", "c"]
