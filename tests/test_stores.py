import random

import pytest

from copyloom.sources import commit_log, history_store, known_links, sinks


def links(spark, names):
    return spark.createDataFrame([(n,) for n in names], "link string")


def got(df):
    rows = [r.link for r in df.select("link").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_log(spark, tmp_path):
    folder = str(tmp_path)
    assert commit_log.entries(spark, folder) == {}
    commit_log.commit(spark, folder, 1, {"a": "ä"})
    with pytest.raises(commit_log.Conflict):
        commit_log.commit(spark, folder, 1, {"a": 2})
    (tmp_path / "_log" / f"{2:020d}.json").write_text('{"a": ')  # broken off
    assert commit_log.entries(spark, folder) == {1: {"a": "ä"}, 2: {}}


def test_increments_equal_one_batch(spark, tmp_path):
    folder, rng = str(tmp_path / "known"), random.Random(1)
    known_links.create(spark, folder, 16)
    seen = set()
    for number in range(3):
        crawl = [f"https://x/{rng.randrange(400)}" for _ in range(300)] + [None]
        new = got(known_links.add(spark, folder, links(spark, crawl), f"c{number}"))
        assert new == {c for c in crawl if c} - seen
        seen |= new
        # The same crawl once more, by name and under another one.
        assert got(known_links.add(spark, folder, links(spark, crawl), f"c{number}")) == new
        assert got(known_links.news(spark, folder, links(spark, crawl))) == set()
        assert got(known_links.known(spark, folder)) == seen
    assert got(known_links.add(spark, folder, links(spark, list(seen)), "again")) == set()
    assert got(known_links.news(spark, folder, links(spark, []))) == set()
    with pytest.raises(commit_log.Conflict):
        known_links.create(spark, folder)
    with pytest.raises(ValueError):
        known_links.create(spark, str(tmp_path / "x"), 0)


def test_only_buckets_that_may_hold_a_link_are_read(spark, tmp_path):
    folder = str(tmp_path / "known")
    known_links.create(spark, folder, 32)
    known_links.add(spark, folder, links(spark, [f"k{i}" for i in range(2000)]), "first")
    told = known_links.asked(spark, folder, links(spark, ["k7", *[f"n{i}" for i in range(500)]])).collect()
    assert next(r for r in told if r.link == "k7").maybe
    assert sum(r.maybe for r in told) < 25  # 500 others, of which a filter lets few through
    bucket = next(r.bucket for r in told if r.link == "k7")
    some = known_links.known(spark, folder, [bucket])
    assert 0 < some.count() < 150
    some.collect()
    plan = some._jdf.queryExecution().executedPlan()
    scan = plan.toString()
    filters = scan.split("PartitionFilters:")[1].split("]")[0]
    assert "bucket" in filters and "increment" in filters
    read = {f for f in some.select("link", "bucket").inputFiles()}
    assert read  # all files of the table; those read are in the scan's metrics
    node = plan
    while node.children().size():
        node = node.children().apply(0)
    assert node.metrics().apply("numFiles").value() == 1


def test_a_crawl_put_in_meanwhile(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "known")
    known_links.create(spark, folder, 4)
    commit, late = commit_log.commit, []

    def slow(session, place, number, entry):
        if not late:
            late.append(1)
            known_links.add(spark, folder, links(spark, ["a", "b"]), "other")
        return commit(session, place, number, entry)

    monkeypatch.setattr(commit_log, "commit", slow)
    assert got(known_links.add(spark, folder, links(spark, ["b", "c"]), "own")) == {"c"}
    assert got(known_links.known(spark, folder)) == {"a", "b", "c"}


RECORD = "domain string, brand_name string, version long"


def rows(df):
    return {(r.domain, r.brand_name, r.version, r.first_saved) for r in df.collect()}


def test_versions_of_history(spark, tmp_path):
    folder = str(tmp_path / "history")
    first = spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], RECORD)
    second = spark.createDataFrame([("a", "A2", 3), ("c", "C", 4)], RECORD)
    assert history_store.newest(spark, folder) == 0
    with pytest.raises(LookupError):
        history_store.read_version(spark, folder)
    assert history_store.put(first, folder, "1") == 1
    assert history_store.put(second, folder, "2") == 2
    assert history_store.put(second, folder, "2") == 2  # repeated
    assert rows(history_store.read_version(spark, folder, 1)) == {("a", "A", 1, 1), ("b", "B", 2, 2)}
    newest = history_store.read_version(spark, folder)
    assert rows(newest) == {("a", "A2", 3, 1), ("b", "B", 2, 2), ("c", "C", 4, 4)}
    with pytest.raises(commit_log.Conflict):
        history_store.save(newest.where("domain = 'a'"), folder, 1)
    assert history_store.save(newest.where("domain = 'a'"), folder, 2) == 3
    assert rows(history_store.read_version(spark, folder)) == {("a", "A2", 3, 1)}
    sinks.write_history(newest, folder)  # never committed, so never seen
    assert history_store.newest(spark, folder) == 3


def test_a_writer_that_is_late_starts_again(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "history")
    commit, late = commit_log.commit, []

    def slow(session, place, number, entry):
        if not late:
            late.append(1)
            history_store.put(spark.createDataFrame([("a", "other", 1)], RECORD), folder, "other")
        return commit(session, place, number, entry)

    monkeypatch.setattr(commit_log, "commit", slow)
    assert history_store.put(spark.createDataFrame([("b", "own", 2)], RECORD), folder, "own") == 2
    assert rows(history_store.read_version(spark, folder)) == {("a", "other", 1, 1), ("b", "own", 2, 2)}


def test_stream_of_records(spark, tmp_path):
    folder, source = str(tmp_path / "history"), tmp_path / "in"
    spark.createDataFrame([("a", "A", 1)], RECORD).write.json(str(source))
    stream = spark.readStream.schema(RECORD).json(str(source))
    for number, name in ((2, "A2"), (3, "A3")):
        query = history_store.put_stream(stream, folder, str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert query.exception() is None
        spark.createDataFrame([("a", name, number)], RECORD).write.mode("append").json(str(source))
    assert history_store.newest(spark, folder) == 2
    assert rows(history_store.read_version(spark, folder)) == {("a", "A2", 2, 1)}
    # A batch that is handed over again after a failure.
    again = spark.createDataFrame([("a", "lost", 9)], RECORD)
    assert history_store.put(again, folder, "history-1") == 2
    assert rows(history_store.read_version(spark, folder)) == {("a", "A2", 2, 1)}
