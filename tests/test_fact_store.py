import pytest

from copyloom.operators import bundle as bundles
from copyloom.sources import commit_log, fact_store

FACTS = (
    "url string, success boolean, error string, title string, meta_desc string, h1 string, body_text string,"
    " product_links array<string>"
)
PARTS = "request_id bigint, role string, role_no int, ordinal int, url string"


def facts(spark):
    rows = [(f"u{i}", i % 5 > 0, None if i % 5 else "bad", f"t{i}", "", "h", "x" * (i % 50), [f"l{i}"]) for i in range(200)]
    return spark.createDataFrame([*rows, (None, True, None, "none", "", "", "", [])], FACTS)


def parts(spark):
    rows = [(i, "brand", 1, 1, "u7" if i % 3 == 0 else "gone" if i % 3 == 1 else f"u{i % 230}") for i in range(600)]
    return spark.createDataFrame([*rows, (900, "collection", 2, 1, None), (900, "collection", 2, 1, None)], PARTS)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def folder(spark, tmp_path):
    return fact_store.write_facts(facts(spark), str(tmp_path / "fa cts"), buckets=5)


@pytest.mark.parametrize("popular, size", [(10_000, 1 << 20), (50, 1 << 20), (50, 0), (0, 1 << 20)])
def test_attached(spark, folder, monkeypatch, popular, size):
    monkeypatch.setattr(fact_store, "POPULAR_ROWS", popular)
    monkeypatch.setattr(fact_store, "POPULAR_SHARE", 0.0)
    monkeypatch.setattr(fact_store, "BROADCAST_BYTES", size)
    want = rows(bundles.attach_facts(parts(spark), facts(spark)))
    assert len(want) == 602 and rows(fact_store.attached(parts(spark), folder)) == want


def test_facts_are_not_shuffled(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        some = fact_store.attached(parts(spark), folder)
        plan = some._jdf.queryExecution().executedPlan().toString()
        got = rows(some)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    lines = plan.splitlines()
    scans = [i for i, line in enumerate(lines) if "Scan parquet" in line and "Bucketed: true" in line]
    assert scans
    for i in scans:
        depth = lines[i].index("FileScan")
        above = []
        for line in reversed(lines[:i]):
            at = len(line) - len(line.lstrip(" :+-"))
            if at < depth:
                above.append(line)
                depth = at
        assert any("SortMergeJoin" in a for a in above)
        below_join = above[: next(k for k, a in enumerate(above) if "SortMergeJoin" in a)]
        assert not any("Exchange" in a for a in below_join)
    assert got == rows(bundles.attach_facts(parts(spark), facts(spark)))


def test_a_store_is_written_once_and_read_by_name(spark, folder):
    with pytest.raises(commit_log.Conflict):
        fact_store.write_facts(facts(spark), folder)
    assert rows(fact_store.read_facts(spark, folder)) == rows(facts(spark))
    assert fact_store.read_facts(spark, folder).where("url = 'u7'").count() == 1
    with pytest.raises(FileNotFoundError):
        fact_store.read_facts(spark, f"{folder}-other")


def test_empty(spark, tmp_path):
    folder = fact_store.write_facts(facts(spark).where("false"), str(tmp_path / "none"), 3)
    assert {r.error for r in fact_store.attached(parts(spark), folder).collect()} == {"not in snapshot"}
    assert fact_store.attached(parts(spark).where("false"), folder).collect() == []
