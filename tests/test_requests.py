from pyspark.sql import functions as F

from copyloom import rules, schemas
from copyloom.functions import keywords as kw
from copyloom.functions import text as tx
from copyloom.operators import bundle as bundles
from copyloom.operators import context as contexts
from copyloom.operators import prompt as prompts
from copyloom.operators import requests as reqs


def request(request_id, **fields):
    base = dict(
        request_id=request_id, brand_name="B", website_url="https://w", collection_url="https://c",
        collection_topic="T", target_market="M", keywords="a, b", competitor_urls=[], product_links=[],
        brand_info="", output_language=None, skip_products=False,
    )
    return tuple((base | fields).values())


def facts(spark, *rows):
    full = [(i, u, ok, None if ok else "e", t, "m", "h", "body " + str(t), list(links), 0) for i, (u, ok, t, links) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.PAGE_FACTS)


# -- lists and keywords -----------------------------------------------------

def test_lists(one):
    assert one(tx.comma_list(F.col("s")), s="a, b,,c ,") == ["a", "b", "c"]
    assert one(tx.line_list(F.col("s")), s=" u1 \n\n u2") == ["u1", "u2"]
    assert one(tx.comma_or_line_list(F.col("s")), s="a\nb, c\n") == ["a", "b", "c"]
    assert one(tx.comma_list(F.col("s")), s=None) == []


def test_keyword_bands(one):
    for typed, n, band in (("a, b,,c ,", 3, "under 5"), ("a,b,c,d,e", 5, "5-10"), (",".join("abcdefghij"), 10, "5-10"), (",".join("abcdefghijk"), 11, "over 10")):
        assert one(kw.keyword_count(F.col("s")), s=typed) == n
        assert one(kw.keyword_band(kw.keyword_count(F.col("s"))), s=typed) == band


def test_pool(one):
    assert one(kw.merge(F.col("a"), F.col("b")), a=["a", "b"], b=["b", "c"]) == ["a", "b", "c"]
    # A batch is compared with the pool only: repeats in it stay.
    assert one(kw.add_typed(F.col("p"), F.col("t")), p=["a"], t="a, b, b") == ["a", "b", "b"]
    assert one(kw.add_single(F.col("p"), F.col("t")), p=["a"], t=" a ") == ["a"]
    assert one(kw.add_single(F.col("p"), F.col("t")), p=["a"], t=" b") == ["a", "b"]
    assert one(kw.pool_size(F.lit(None).cast("array<string>"))) == 0


def test_text_helpers(one):
    assert one(tx.escape_html(F.col("s")), s="<a href=\"x\">&</a>'") == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;'"
    assert one(tx.escape_attr(F.col("s")), s="\"x\" 'y' <&") == "&quot;x&quot; &#39;y&#39; <&"
    assert one(tx.language_flag(F.col("s")), s="Dutch") == "🇳🇱"
    assert one(tx.language_flag(F.col("s")), s="Polish") == "🌐"
    assert one(tx.joined_or(F.col("s"), "d"), s=["a", "b"]) == "a, b"
    assert one(tx.joined_or(F.col("s"), "d"), s=[]) == "d"
    snippet = "<h1 id=x>t</h1><h2>A</h2><p>b</p><ul><li>c</li></ul><h3>D</h3>\n\n\n\n<ol></ol>"
    assert one(tx.tidy_snippet(F.col("s")), s=snippet) == "<h2>A</h2>\n<p>b</p>\n<ul><li>c</li></ul>\n\n<h3>D</h3>\n\n<ol></ol>"


# -- requests -----------------------------------------------------------------

def test_required_fields(spark):
    df = spark.createDataFrame([request(1, brand_name="", keywords=None, output_language="English"), request(2, output_language="X")], schemas.REQUESTS)
    rows = {r.request_id: r for r in reqs.validated(df).collect()}
    assert rows[1].missing == ["brand_name", "keywords"] and not rows[1].valid
    assert rows[2].missing == [] and rows[2].valid


def test_parts(spark):
    df = spark.createDataFrame(
        [request(1, competitor_urls=[" https://a ", " ", "https://b"]), request(2, website_url=""), request(3, collection_url="")],
        schemas.REQUESTS,
    )
    got = sorted((r.request_id, r.role_no, r.ordinal, r.url) for r in reqs.request_parts(df).collect())
    assert got == [
        (1, 1, 1, "https://w"), (1, 2, 1, "https://c"), (1, 4, 1, "https://a"), (1, 4, 2, "https://b"),
        (2, 2, 1, "https://c"),
    ]
    accepted, rejected = reqs.split_by_address(df)
    assert (accepted.count(), rejected.count()) == (2, 1)


def test_form_values(spark):
    raw = spark.createDataFrame(
        [(1, " b ", "u1\n \nu2", "custom", " Polish "), (2, None, None, "custom", " "), (3, "", "", None, None)],
        "request_id long, brand_name string, competitor_urls string, output_language string, custom_language string",
    )
    for c in ("website_url", "collection_url", "collection_topic", "target_market", "keywords", "brand_info", "product_links"):
        raw = raw.withColumn(c, F.lit(""))
    rows = {r.request_id: r for r in reqs.form_values(raw).collect()}
    assert (rows[1].brand_name, rows[1].competitor_urls, rows[1].output_language) == ("b", ["u1", "u2"], "Polish")
    assert (rows[2].brand_name, rows[2].competitor_urls, rows[2].output_language) == ("", [], "English")
    assert rows[3].output_language == "English"


# -- bundles ------------------------------------------------------------------

def test_bundle_status_and_queue(spark):
    df = spark.createDataFrame(
        [
            request(1, competitor_urls=["https://x1", "https://x2"]),
            request(2, skip_products=True),
        ],
        schemas.REQUESTS,
    )
    links = [f"https://p/{i}" for i in range(40)]
    page_facts = facts(spark, ("https://w", False, "w", []), ("https://c", True, "c", links), ("https://x2", True, "x", []), ("https://p/0", True, "p0", []))
    bundle = bundles.request_bundle(df, page_facts, limit=3)
    rows = {(r.request_id, r.role, r.ordinal): r for r in bundle.collect()}
    assert len(rows) == 2 + 2 + 3 + 2
    assert rows[1, "product", 1].title == "p0" and rows[1, "product", 1].success
    assert rows[1, "product", 3].error == "not in snapshot" and not rows[1, "product", 3].success
    assert not rows[1, "competitor", 1].success and rows[1, "competitor", 2].title == "x"
    assert rows[1, "brand", 1].error == "e"
    status = {(r.request_id, r.role): (r.ok, r.total, r.status) for r in bundles.fetch_status(bundle).collect()}
    assert status[1, "competitor"] == (1, 2, "fail") and status[1, "collection"] == (1, 1, "ok")
    assert (2, "product") not in status
    queue = sorted((r.request_id, r.queue_no, r.type, r.url) for r in bundles.failed_queue(bundle).collect())
    assert queue == [
        (1, 1, "brand", "https://w"), (1, 2, "product", "https://p/1"), (1, 3, "product", "https://p/2"),
        (1, 4, "competitor", "https://x1"), (2, 1, "brand", "https://w"),
    ]


def test_first_copy_of_a_page_counts(spark):
    copies = facts(spark, ("u", True, "first", []), ("u", True, "second", []), ("v", True, "v", []))
    assert {r.url: r.title for r in bundles.facts_by_url(copies).collect()} == {"u": "first", "v": "v"}


# -- context ------------------------------------------------------------------

def bundle_rows(spark, *rows):
    full = [(i, role, rules.ROLE_NO[role], n, url, ok, None, "T" + url, "M", "H", "B", []) for i, role, n, url, ok in rows]
    return spark.createDataFrame(
        full,
        "request_id long, role string, role_no int, ordinal int, url string, success boolean, error string, "
        "title string, meta_desc string, h1 string, body_text string, product_links array<string>",
    )


def test_backfill(spark):
    bundle = bundle_rows(
        spark, (1, "brand", 1, "w", True), (1, "product", 1, "p1", True), (1, "product", 2, "p2", False),
        (1, "product", 3, "p3", True), (1, "competitor", 1, "x", False), (2, "brand", 1, "w", False), (2, "collection", 1, "c", False),
    )
    overrides = spark.createDataFrame(
        [
            (1, "brand", "w", "typed", 1), (1, "competitor", "x", "taken back", 1), (1, "competitor", "x", "  ", 2),
            (2, "brand", "first", "first", 1), (2, "brand", "other", " typed ", 2), (2, "product", "q", "never asked", 1),
        ],
        schemas.OVERRIDES,
    )
    got = sorted((r.request_id, r.role, r.ordinal, r.source) for r in contexts.backfilled(bundle, overrides).collect())
    typed = contexts.backfilled(bundle, overrides).where("source = 'override'").collect()
    assert [r.override for r in typed] == ["typed"]
    assert got == [(1, "brand", 1, "facts"), (1, "product", 1, "facts"), (1, "product", 3, "facts"), (2, "brand", 1, "override")]


def test_context_text(spark):
    bundle = bundle_rows(
        spark, (1, "collection", 1, "c", False), (1, "product", 1, "p1", False), (1, "product", 2, "p2", True),
        (1, "competitor", 1, "x1", False), (1, "competitor", 2, "x2", False),
    )
    overrides = spark.createDataFrame(
        [
            (1, "brand", None, "about us", 2), (1, "brand", None, "before", 1), (1, "competitor", "x2", "seen", 1),
            (2, "brand", None, "ignored", 1), (2, "collection", None, "ignored", 1),
        ],
        schemas.OVERRIDES,
    )
    requests = spark.createDataFrame([request(1, product_links=["l1", "l2"]), request(2), request(3, product_links=["l"])], schemas.REQUESTS)
    got = {r.request_id: r.context for r in contexts.context(requests, bundle, overrides).collect()}
    assert got[1] == (
        "\n\n## 品牌官网内容（手动补充）\nabout us\n"
        "\n\n## 产品详情页内容\n"
        "\n### 产品 2：Tp2（p2）\nMeta描述：M\nH1：H\n正文摘要：B\n"
        "\n\n## 竞品集合页内容\n"
        "\n### 竞品 2（手动补充，x2）\nseen\n"
        "\n\n## 产品链接列表（手动输入）\n共 2 个产品：\n1. l1\n2. l2\n"
    )
    # Without scraped data a replacement is ignored.
    assert got[2] == ""
    assert got[3] == "\n\n## 产品链接列表（手动输入）\n共 1 个产品：\n1. l\n"


def test_context_of_read_pages(spark):
    bundle = bundle_rows(spark, (1, "brand", 1, "w", True), (1, "collection", 1, "c", True))
    none = spark.createDataFrame([], schemas.OVERRIDES)
    requests = spark.createDataFrame([request(1)], schemas.REQUESTS)
    assert contexts.context(requests, bundle, none).first().context == (
        "\n\n## 品牌官网内容（https://w）\n标题：Tw\nMeta描述：M\n正文摘要：B\n"
        "\n\n## 集合页内容（https://c）\n标题：Tc\nMeta描述：M\n正文摘要：B\n"
    )


# -- prompts ------------------------------------------------------------------

def test_prompt_variants(spark):
    template = "{{brand_name}}|{{competitor_info}}|{{competitor_list}}|{{product_info}}|{{brand_info}}|{{output_language}}|{{output_language}}"
    requests = spark.createDataFrame(
        [
            request(1),
            request(2, brand_name="{{brand_info}}", competitor_urls=["a", "b"], product_links=["p"], brand_info="i", output_language="French"),
            request(3, brand_name=None, competitor_urls=None, product_links=None, brand_info=None),
        ],
        schemas.REQUESTS,
    )
    got = {r.request_id: r.prompt for r in prompts.prompts(requests, template).collect()}
    assert got[1] == f"B|{rules.NO_COMPETITORS}||未提供|未提供|English|English"
    assert got[2] == "{{brand_info}}|a, b|a,b|p|i|French|French"
    assert got[3] == f"|{rules.NO_COMPETITORS}||未提供|未提供|English|English"


def test_default_prompt_and_context(spark):
    requests = spark.createDataFrame([request(1, brand_name="Acme")], schemas.REQUESTS)
    plain = prompts.prompts(requests).first().prompt
    assert "| brand_name | brand | Acme |" in plain and "{{" not in plain
    for heading in rules.MODULE_HEADINGS:
        assert heading in plain
    context = spark.createDataFrame([(1, "\n\nctx")], "request_id long, context string")
    assert prompts.prompts(requests, contexts=context).first().prompt == plain + "\n\nctx"


def test_request_json(one):
    body = one(prompts.request_json(F.col("p")), p='a "b"\n')
    assert body == (
        '{"contents":[{"role":"user","parts":[{"text":"a \\"b\\"\\n"}]}],'
        '"generationConfig":{"temperature":0.7,"maxOutputTokens":65536,"topP":0.95}}'
    )
