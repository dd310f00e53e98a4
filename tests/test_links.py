import pytest
from pyspark.sql import functions as F

from copyloom import schemas
from copyloom.functions import urls
from copyloom.operators import links


@pytest.mark.parametrize(
    "url, html, platform",
    [
        ("https://x/collections/a", "wp-content", "shopify"),
        ("https://x/c", "cdn.SHOPIFY.com", "shopify"),
        ("https://x/c", "WooCommerce", "woocommerce"),
        ("https://x/c", "/WP-content/", "woocommerce"),
        ("https://x/c", "shopyy", "shopyy"),
        ("https://x/shopping", "-", "odoo"),
        ("https://shop.x/c", "-", "odoo"),
        ("https://x/c", "Odoo", "odoo"),
        ("https://x/c", "-", "unknown"),
        ("https://x/Collections/a", "-", "unknown"),
    ],
)
def test_platform(one, url, html, platform):
    assert one(urls.detect_platform(F.col("u"), F.col("h")), u=url, h=html) == platform


@pytest.fixture
def extract(spark):
    def run(html, marker, strict=False, url="https://x/c"):
        pages = spark.createDataFrame([(1, url, f"<!-- {marker} -->" + html)], schemas.PAGES)
        row = links.extract_links(pages, strict).first()
        return row.links, row.scope_used

    return run


def test_shopify(extract):
    grid = '<div id="product-grid"><a href="/products/a/">1</a><p><a href="/products/a?v=2">2</a></div>'
    assert extract(grid + '<a href="/products/z">z</a>', "shopify") == (["https://x/products/a"], "container")
    by_class = '<ul class="x my-product-list-2"><a href="/products/b">1</a></ul><a href="/products/z">z</a>'
    assert extract(by_class, "shopify") == (["https://x/products/b"], "container")
    # The id wins over an earlier class.
    both = '<div class="product-list"><a href="/products/c">1</a></div>' + grid
    assert extract(both, "shopify")[0] == ["https://x/products/a"]
    assert extract('<nav><a href="/products/c">1</a></nav>', "shopify") == (["https://x/products/c"], "page")
    assert extract('<div id="product-grid"></div><a href="/products/c">1</a>', "shopify") == ([], "container")
    assert extract('<a href="/products/a#r">1</a>', "shopify")[0] == ["https://x/products/a#r"]


def test_woocommerce(extract):
    items = '<a href="/?product=a">1</a><a href="/?product=b&x=1">2</a><a href="/product/c/?q">3</a>'
    assert extract(items, "woocommerce", strict=True)[0] == ["https://x", "https://x/product/c"]
    assert extract(items, "woocommerce")[0] == ["https://x/?product=a", "https://x/?product=b", "https://x/product/c"]
    scoped = '<div class="products"><a href="/product/d">1</a></div><ul class="a products"><a href="/product/e">2</a></ul>'
    assert extract(scoped, "woocommerce")[0] == ["https://x/product/e"]
    assert extract('<p class="woocommerce-loop"><a href="/product/d">1</a></p><a href="/product/o">o</a>', "wp-content")[0] == ["https://x/product/d"]


def test_shopyy(extract):
    html = '<div class="goods-list"><a href="/goods/1">1</a><a href="/about">a</a></div><a href="/product/2">2</a>'
    assert extract(html, "shopyy") == (["https://x/goods/1"], "container")


def test_odoo(extract):
    html = '<a href="/shop/">1</a><a href="https://x/shop/">2</a><a href="/shop/a-1">3</a>'
    assert extract(html, "odoo") == (["https://x/shop", "https://x/shop/a-1"], "page")
    assert extract('<a href="/shop/z">z</a><div id="products">' + html + "</div>", "odoo")[1] == "container"
    assert extract('<a href="/shop/z">z</a><td class="o_wsale_p"><a href="/shop/b">b</a></td>', "odoo")[0] == ["https://x/shop/b"]


def test_unknown(extract):
    html = '<a href="/item/1">1</a><a href="/about">2</a><a href="/products-x">3</a><a href="detail/9">4</a>'
    assert extract(html, "-") == (["https://x/item/1", "https://x/products-x"], "page")


def test_container_closes_with_its_tag(extract):
    html = '<div id="product-grid"><div><a href="/products/a">1</a></div></div><a href="/products/b">2</a>'
    assert extract(html, "shopify")[0] == ["https://x/products/a"]
    # Unclosed inner tags end with the container.
    html = '<div id="product-grid"><p><b><a href="/products/a">1</div><a href="/products/b">2</a>'
    assert extract(html, "shopify")[0] == ["https://x/products/a"]


def test_canonical_is_idempotent(one):
    for url in ("https://x/a//?b=1", "https://x/?", "https://x/a#f/", "a/?b?c"):
        once = one(urls.canonical(F.col("u")), u=url)
        assert one(urls.canonical(F.col("u")), u=once) == once


def test_overall_sequence_and_limit(spark):
    rows = [(1, 1, "b"), (1, 2, "a"), (2, 1, "a"), (2, 2, "c"), (3, 1, "b")]
    df = spark.createDataFrame(rows, "page_no int, ordinal int, link string")
    got = {r.link: r.seq for r in links.overall_sequence(df, ["page_no", "ordinal"]).collect()}
    assert got == {"b": 1, "a": 2, "c": 3}
    per_page = spark.createDataFrame([(1, ["a", "b", "c"])], "page_id int, links array<string>")
    assert [r.link for r in links.explode_links(per_page, 2).collect()] == ["a", "b"]


def test_not_yet_known(spark):
    known = spark.createDataFrame([("a",)], "link string")
    found = spark.createDataFrame([("a",), ("b",)], "link string")
    assert [r.link for r in links.not_yet_known(found, known).collect()] == ["b"]
    assert [r.link for r in links.not_yet_known(found, known).collect()] == ["b"]


@pytest.mark.parametrize(
    "base, platform, n, expected",
    [
        ("https://x/c", "shopify", 2, "https://x/c?page=2"),
        ("https://x/c?s=1", "woocommerce", 3, "https://x/c?s=1&paged=3"),
    ],
)
def test_page_url(one, base, platform, n, expected):
    assert one(urls.page_url(F.col("b"), F.lit(n), F.col("p")), b=base, p=platform) == expected


@pytest.mark.parametrize(
    "url, host, strict",
    [
        ("x.example/p", "x.example", None),
        ("https://X.example:8080/", "x.example", "x.example"),
        ("http://u:p@A_b.example/x", "a_b.example", "a_b.example"),
        ("", "", None),
        ("no host", "", None),
        (" https://y.example ", "", "y.example"),
        ("httpbin", "", None),
        ("ftp://z.example", "ftp", "z.example"),
    ],
)
def test_domains(one, url, host, strict):
    assert one(urls.domain(F.col("u")), u=url) == host
    assert one(urls.strict_domain(F.col("u")), u=url) == strict
