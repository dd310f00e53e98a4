import json

from copyloom import schemas
from copyloom.plans import flows
from copyloom.plans.workdir import new_path, work_dir
from copyloom.sources import sinks, snapshots


def test_work_dir_is_the_named_one(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_path(spark, "x") != new_path(spark, "x")


def test_links_csv(spark, tmp_path):
    links = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c,\"d")], "seq long, link string")
    assert sinks.write_links(links, str(tmp_path / "out"))
    texts = [p.read_text("utf-8") for p in sorted((tmp_path / "out").glob("part-*.csv"))]
    assert all(t.startswith("序号,product_url\n") for t in texts if t)
    body = [line for t in texts for line in t.splitlines()[1:]]
    assert [line.split(",")[0] for line in body] == ["1", "2", "3"]
    assert not sinks.write_links(links.where("seq > 9"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_requests(spark, tmp_path):
    file = tmp_path / "r.json"
    file.write_text('{"request_id": 1, "competitor_urls": ["a"], "other": 2}\n{broken\n')
    rows = snapshots.read_requests(spark, str(file)).collect()
    assert sorted((r.request_id or 0, r.competitor_urls) for r in rows) == [(0, None), (1, ["a"])]


def test_history_versions(spark, tmp_path):
    rows = spark.createDataFrame([("a",)], "domain string")
    first, second = (sinks.write_history(rows, str(tmp_path)) for _ in range(2))
    assert first != second and spark.read.parquet(first).count() == 1
    (tmp_path / "h.json").write_text('[{"domain": "a"}, {"domain": "b"}]')
    (tmp_path / "bad.json").write_text("[{")
    assert snapshots.read_history(spark, str(tmp_path / "*.json")).count() == 2


def test_payload_file(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "hello")], "request_id long, prompt string")
    sinks.write_requests(prompts, str(tmp_path / "p"))
    row = spark.read.json(str(tmp_path / "p")).first()
    assert json.loads(row.body)["contents"][0]["parts"][0]["text"] == "hello"


def test_whole_flows(spark):
    pages = spark.createDataFrame(
        [(1, "https://w", "<title>Brand</title>"), (2, "https://c", '<h1>C</h1><a href="/products/a">a</a>')], schemas.PAGES
    )
    requests = spark.createDataFrame(
        [(1, "B", "https://w", "https://c", "T", "M", "k", ["https://x"], [], "", "English", False)], schemas.REQUESTS
    )
    gathered = flows.gather(requests, pages)
    assert {(r.role, r.status) for r in gathered.status.collect()} == {
        ("brand", "ok"), ("collection", "ok"), ("product", "fail"), ("competitor", "fail"),
    }
    assert gathered.failed.count() == 2
    typed = spark.createDataFrame([(1, "competitor", "https://x", "seen", 1)], schemas.OVERRIDES)
    body = flows.payloads(requests, gathered.bundle, typed, include_context=True).first()
    assert "seen" in body.prompt and "Brand" in body.prompt and json.loads(body.body)
    assert "seen" not in flows.payloads(requests, gathered.bundle, typed).first().prompt
    generations = spark.createDataFrame([(1, 1, "## 📝 Collection Page Copy\nUnlock it", "done", None)], schemas.GENERATIONS)
    keywords = spark.createDataFrame([(1, ["k"])], "request_id long, keywords array<string>")
    issues = flows.reviewed(flows.finished(generations), keywords)
    assert "banned_word" in {r["check"] for r in issues.collect()}
    listing = spark.createDataFrame([("https://x/c", 1, '<a href="/item/1">1</a>', True)], schemas.LISTING_PAGES)
    links, stops = flows.collect_links(listing)
    assert [tuple(r) for r in links.collect()] == [("https://x/c", 1, "https://x/item/1")]
    assert stops.first().stop_reason == "empty"
