import random

import pytest
from pyspark.sql import functions as F

from copyloom import schemas
from copyloom.operators import paging
from copyloom.sources import sinks, snapshots


def loop(pages, max_pages, clicked=False):
    """The paging loop, page by page: {page_no: (links, has_next)} → links, stop page, reason."""
    seen, page = [], 1
    while page <= max_pages:
        links, has_next = pages.get(page, (None, False))
        if links is None and not clicked:
            return seen, page, "empty"
        if not links:
            return seen, page, "no_links"
        new = [x for x in dict.fromkeys(links) if x not in seen]
        if not new:
            return seen, page, "no_new"
        seen += new
        page += 1
        if clicked and not has_next:
            return seen, page, "no_next"
    return seen, page, "max_pages"


def tables(spark, shops):
    links, pages = [], []
    for shop, by_page in shops.items():
        for no, (found, has_next) in by_page.items():
            pages.append((shop, no, found is None, has_next, len(found or [])))
            links += [(shop, no, i, x) for i, x in enumerate(found or [], 1)]
    return (
        spark.createDataFrame(links, "collection_url string, page_no int, ordinal int, link string"),
        spark.createDataFrame(pages, "collection_url string, page_no int, empty boolean, has_next boolean, n_links int"),
    )


def run(spark, shops, max_pages, clicked=False):
    links, pages = tables(spark, shops)
    kept, stops = paging.paged_links(links, pages, max_pages, clicked)
    got = {shop: [] for shop in shops}
    for row in paging.with_sequence(kept).orderBy("collection_url", "seq").collect():
        got[row.collection_url].append((row.seq, row.link))
    ends = {r.collection_url: (r.stop_page, r.stop_reason) for r in stops.collect()}
    return got, ends


def test_fixed_cases(spark):
    shops = {
        "no_new": {1: ("ab", 1), 2: ("bc", 1), 3: ("a", 1), 4: ("d", 1)},
        "empty": {1: ("a", 1), 2: (None, 1), 3: ("b", 1)},
        "no_links": {1: ("a", 1), 2: ("", 1)},
        "missing": {2: ("a", 1)},
        "long": {1: ("a", 1), 2: ("b", 1), 3: ("c", 1)},
    }
    shops = {s: {n: (None if l is None else list(l), True) for n, (l, _) in p.items()} for s, p in shops.items()}
    got, ends = run(spark, shops, 20)
    assert [x for _, x in got["no_new"]] == ["a", "b", "c"]
    assert ends == {
        "no_new": (3, "no_new"), "empty": (2, "empty"), "no_links": (2, "no_links"),
        "missing": (1, "empty"), "long": (4, "empty"),
    }
    got, ends = run(spark, {"long": shops["long"]}, 2)
    assert ([x for _, x in got["long"]], ends["long"]) == (["a", "b"], (3, "max_pages"))


@pytest.mark.parametrize("clicked", [False, True])
def test_against_the_loop(spark, clicked):
    rng = random.Random(7)
    shops = {}
    for i in range(300):
        numbers = [n for n in range(1, 8) if rng.random() < 0.85] or [1]
        shops[f"s{i}"] = {
            n: (
                rng.choice([None, [], *[[rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))] for _ in range(8)]]),
                rng.random() < 0.8,
            )
            for n in numbers
        }
    got, ends = run(spark, shops, 5, clicked)
    for shop, pages in shops.items():
        links, stop, reason = loop(pages, 5, clicked)
        assert got[shop] == list(enumerate(links, 1)), (shop, pages)
        assert ends.get(shop, (1, reason)) == (stop, reason), (shop, pages)


def test_fewer_pages_give_a_prefix(spark):
    shops = {"s": {n: ([f"l{n}", f"l{n + 1}"], True) for n in range(1, 7)}}
    for n in range(1, 5):
        less, more = run(spark, shops, n)[0]["s"], run(spark, shops, n + 1)[0]["s"]
        assert more[: len(less)] == less


def test_totals(spark):
    links, pages = tables(spark, {"s": {1: (["a", "b"], True), 2: (["b", "c"], True)}})
    kept, _ = paging.paged_links(links, pages)
    rows = paging.page_totals(kept).orderBy("page_no").collect()
    assert [(r.page_no, r.new_links, r.total_links) for r in rows] == [(1, 2, 2), (2, 1, 3)]
    assert paging.total_links(kept).first().n_links == 3


def test_crawl(spark):
    base = "https://x/collections/a"
    html = '<div class="product-list">{}</div><a href="/products/out">o</a>'
    page = lambda *names: html.format("".join(f'<a href="{n}">.</a>' for n in names))
    listing = spark.createDataFrame(
        [
            (base, 1, page("/products/a", "../products/b?x=1", "products/c"), True),
            (base, 2, page("/products/b", "/products/a/"), True),
            (base, 3, page("/products/c"), True),
            ("https://y/shop", 1, '<a href="/shop/q">q</a>', True),
            ("https://y/shop", 2, "", True),
            ("https://y/shop", 3, None, True),
        ],
        schemas.LISTING_PAGES,
    )
    kept, stops = paging.crawl(listing)
    assert sorted((r.collection_url, r.page_no, r.link) for r in kept.collect()) == [
        (base, 1, "https://x/products/a"),
        (base, 1, "https://x/products/b"),
        ("https://y/shop", 1, "https://y/shop/q"),
    ]
    assert {r.collection_url: (r.stop_page, r.stop_reason) for r in stops.collect()} == {
        base: (2, "no_new"), "https://y/shop": (2, "empty"),
    }


def test_frontier(spark):
    shops = spark.createDataFrame([("https://x/c", "shopify")], "collection_url string, platform string")
    assert [r.page_url for r in paging.frontier(shops, 2).orderBy("page_no").collect()] == [
        "https://x/c?page=1", "https://x/c?page=2",
    ]


def test_preview(spark):
    rows = spark.createDataFrame([(i,) for i in range(9, 0, -1)], "seq int")
    assert [r.seq for r in paging.first_rows(rows, ["seq"]).collect()] == [1, 2, 3, 4, 5]


def shop_pages(n, seed):
    """Listing pages with links that come again, pages without any, empty and missing ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = f"https://x{i}/collections/a" if i % 3 else f"https://x{i}/list"
        for no in range(1, rng.randint(2, 11)):
            if rng.random() < 0.06:
                continue
            names = [rng.choice("abcdefghijklmnopqrst") for _ in range(rng.choice([0, 1, 3, 4]))]
            html = "".join(f'<a href="/products/{x}">.</a>' for x in names)
            rows.append((base, no, rng.choice([None, "", html, html, html, html, html, html]), rng.random() < 0.9))
    return rows


@pytest.mark.parametrize("wave,clicked", [(1, False), (2, True), (3, False), (20, False)])
def test_waves_collect_the_same(spark, tmp_path, wave, clicked):
    rows = shop_pages(60, wave)
    path = str(tmp_path / "listing")
    sinks.write_listing(spark.createDataFrame(rows, schemas.LISTING_PAGES), path)
    listing = snapshots.read_listing(spark, path)
    links, stops = paging.crawl(listing, 8, clicked)
    done = paging.crawl_in_waves(listing, 8, clicked, wave=wave)
    for ours, theirs in ((done.links, links), (done.stops, stops)):
        assert sorted(map(tuple, ours.select(*theirs.columns).collect())) == sorted(map(tuple, theirs.collect()))
    ends = {r.collection_url: r.stop_page for r in stops.collect()}
    assert len(set(ends.values())) > 3
    read = [(r.collection_url, r.page_no) for r in done.read.collect()]
    assert len(read) == len(set(read))
    # Only pages of the wave that a collection stops in, and before.
    upto = {c: min(8, -(-stop // wave) * wave) for c, stop in ends.items()}
    assert sorted(read) == sorted((c, no) for c, no, *_ in rows if no <= upto[c])
    if wave < 4:
        assert len(read) < 0.8 * len([r for r in rows if r[1] <= 8])


def test_a_wave_reads_its_own_files(spark, tmp_path):
    path = str(tmp_path / "listing")
    sinks.write_listing(spark.createDataFrame(shop_pages(5, 1), schemas.LISTING_PAGES), path)
    some = snapshots.read_listing(spark, path).where("page_no between 3 and 4")
    assert {f.split("page_no=")[1][0] for f in some.inputFiles()} >= {"3", "4"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(page_no" in plan


def test_waves_of_nothing(spark):
    none = spark.createDataFrame([], schemas.LISTING_PAGES)
    done = paging.crawl_in_waves(none)
    assert done.links.count() == done.stops.count() == done.read.count() == 0
    with pytest.raises(ValueError):
        paging.crawl_in_waves(none, wave=0)
