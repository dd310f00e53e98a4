"""Pages, links and paging over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom import rules
from copyloom.catalog import Tables, query, sql_domain, sql_squeeze, sql_strip
from copyloom.functions import urls
from copyloom.operators import links, paging
from copyloom.operators.pages import page_facts as facts_of
from copyloom.plans.workdir import new_path
from copyloom.sources import known_links
from copyloom.sources.sinks import SEQUENCE_HEADER, write_links

# Strips what page facts leave out; `amp` is also decoded without its semicolon.
_PLAIN = (
    "replace(replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'),"
    " '&quot;', '\"'), '&lt;', '<'), '&gt;', '>')"
)


def _plain(x: str) -> str:
    return f"regexp_replace({_PLAIN.format(x=x)}, '&amp;?', '&', 'g')"


_STRIPPED_PAGES = r"""
stripped AS (
  SELECT page_id, url, regexp_replace(
    regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
    '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<nav\b[^>]*>.*?</nav>|<footer\b[^>]*>.*?</footer>',
    '', 'g') AS h
  FROM {pages}
)"""


@query(
    f"""
WITH {_STRIPPED_PAGES.format(pages='pages')},
parts AS (
  SELECT page_id,
    regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1) AS t,
    regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1,
    regexp_replace(h, '(?is)^.*?<body[^>]*>', '') AS b
  FROM stripped
)
SELECT page_id, true AS success, {sql_strip(_plain('t'))} AS title, '' AS meta_desc,
  {sql_strip(_plain('h1'))} AS h1, substr({sql_squeeze(_plain('b'))}, 1, 8000) AS body_text,
  CAST(0 AS BIGINT) AS n_links
FROM parts"""
)
def page_facts(t: Tables) -> DataFrame:
    return facts_of(t.pages).select(
        "page_id", "success", "title", "meta_desc", "h1", "body_text",
        F.size("product_links").cast("long").alias("n_links"),
    )


# Descriptions put at the start of the head or of the body, and what they give; `{u}` is the address in the page.
_DESCRIBED = (
    ("head", '<meta name="description" content=" Of {u} "><meta name="description" content="second">', "' Of ' || url || ' '"),
    ("head", '<META Name="description" Content="Upper &quot;{u}&quot;">', """'Upper "' || url || '"'"""),
    ("head", '<meta name="Description" content="no"><meta content="of {u}" name=description>', "'of ' || url"),
    ("head", '<meta name="description"><meta name="description" content="{u}">', "''"),
    ("body", '<svg><meta name="description" content="drawn"/></svg><p><meta name="description" content="{u}"></p>', "url"),
    ("body", '<!--<meta name="description" content="{u}">--><meta property="og:description" content="{u}">', "''"),
)


@query(
    f"""
SELECT page_id, CASE page_id % {len(_DESCRIBED)} {' '.join(f"WHEN {i} THEN {w}" for i, (_, _, w) in enumerate(_DESCRIBED))} END AS meta_desc
FROM pages"""
)
def page_descriptions(t: Tables) -> DataFrame:
    """All pages with meta descriptions: the first one counts, whatever the case of its names, not in drawings or comments."""
    address = F.replace("url", F.lit("&"), F.lit("&amp;"))
    html = F.col("html")
    for i, (place, tags, _) in enumerate(_DESCRIBED):
        before, behind = tags.split("{u}", 1)
        parts = [F.lit(f"<{place}>{before}")]
        for more in behind.split("{u}"):
            parts += [address, F.lit(more)]
        put = F.replace("html", F.lit(f"<{place}>"), F.concat(*parts))
        html = F.when(F.col("page_id") % len(_DESCRIBED) == i, put).otherwise(html)
    return facts_of(t.pages.select("page_id", "url", html.alias("html"))).select("page_id", "meta_desc")


_HREFS = r"""hrefs AS (
  SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+') AS site,
    regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS a
  FROM pages
),
anchors AS (
  SELECT page_id, url, site, unnest(a) AS href, generate_subscripts(a, 1) AS ord FROM hrefs
)"""


@query(
    f"""
WITH {_HREFS}
SELECT page_id, CAST(ord AS BIGINT) AS ordinal, href, site || href AS link FROM anchors"""
)
def page_links(t: Tables) -> DataFrame:
    return links.page_anchors(t.pages).select(
        "page_id", F.col("ordinal").cast("long").alias("ordinal"), "href", "link"
    )


_CANONICAL = "rtrim(split_part(site || href, '?', 1), '/')"


def _ranked(source: str, key: str, where: str = "true", limit: int | None = None) -> str:
    """Distinct `key` per page, numbered by first occurrence."""
    sql = f"""
WITH {_HREFS},
firsts AS (SELECT page_id, {key} AS link, min(ord) AS o FROM {source} WHERE {where} GROUP BY ALL),
ranked AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) AS ordinal, link FROM firsts)
SELECT page_id, ordinal, link FROM ranked"""
    return sql + (f" WHERE ordinal <= {limit}" if limit else "")


def _long(per_page: DataFrame, limit: int | None = None) -> DataFrame:
    return links.explode_links(per_page, limit).select(
        "page_id", F.col("ordinal").cast("long").alias("ordinal"), "link"
    )


@query(_ranked("anchors", _CANONICAL, "contains(href, 'th')"))
def link_filter_distinct(t: Tables) -> DataFrame:
    return _long(links.distinct_links(t.pages, lambda h: h.contains("th")))


@query(_ranked("anchors", "site || href"))
def links_exact_distinct(t: Tables) -> DataFrame:
    return _long(links.distinct_links(t.pages, lambda h: h != "", canonical=False))


@query(_ranked("anchors", "site || href", limit=3))
def links_top_k(t: Tables) -> DataFrame:
    return _long(links.distinct_links(t.pages, lambda h: h != "", canonical=False), limit=3)


@query(
    f"""
WITH {_HREFS},
firsts AS (SELECT href AS link, min((page_id, ord)) AS p FROM anchors GROUP BY href)
SELECT row_number() OVER (ORDER BY p) AS seq, link FROM firsts"""
)
def links_global_first(t: Tables) -> DataFrame:
    anchors = links.page_anchors(t.pages).select("page_id", "ordinal", F.col("href").alias("link"))
    return links.overall_sequence(anchors, ["page_id", "ordinal"])


@query("SELECT page_id, rtrim(split_part(url, '?', 1), '/') AS canonical FROM pages")
def canonical_urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.canonical(F.col("url")).alias("canonical"))


# Gives every sixth page the mark of another platform.
_MARKED_HTML = """html || CASE page_id % 6 WHEN 0 THEN '<!-- cdn.Shopify -->' WHEN 1 THEN '<i class="WooCommerce">'
  WHEN 2 THEN '/wp-content/' WHEN 3 THEN 'ShopYY' WHEN 4 THEN 'Odoo' ELSE '' END"""
_MARKED_URL = "CASE WHEN page_id % 7 = 0 THEN url || '/collections/a' WHEN page_id % 7 = 1 THEN url || '/shopping' ELSE url END"


@query(
    f"""
WITH marked AS (SELECT page_id, {_MARKED_URL} AS u, lower({_MARKED_HTML}) AS h FROM pages)
SELECT page_id, CASE
  WHEN contains(h, 'shopify') OR contains(u, '/collections/') THEN 'shopify'
  WHEN contains(h, 'woocommerce') OR contains(h, 'wp-content') THEN 'woocommerce'
  WHEN contains(h, 'shopyy') THEN 'shopyy'
  WHEN contains(h, 'odoo') OR contains(u, '/shop') THEN 'odoo'
  ELSE 'unknown' END AS platform
FROM marked"""
)
def platform_class(t: Tables) -> DataFrame:
    marked = t.pages.select(
        "page_id", F.expr(_MARKED_URL).alias("u"), F.expr(_MARKED_HTML).alias("h")
    )
    return marked.select(
        "page_id", urls.detect_platform(F.col("u"), F.col("h")).alias("platform")
    )


# Shop pages made of the driver pages: product paths, and a container of the
# platform's kind in place of the navigation bar; pages without one fall back.
_SHOP = {
    "shopify": ("Shopify", "/products/", ['<nav id="product-grid">', '<nav class="my-product-list x">', "<nav>"]),
    "woocommerce": ("wp-content", "/product/", ['<nav class="woocommerce-loop">', '<nav class="a products">', "<nav>"]),
    "shopyy": ("shopyy", "/goods/", ['<nav class="goods-list">', '<nav class="product-grid">', "<nav>"]),
    "odoo": ("odoo", "/shop/", ['<nav id="products">', '<nav class="o_wsale_grid">', "<nav>"]),
}
_NAMES = list(_SHOP)


def _shop_cases() -> str:
    cases = []
    for i, (marker, path, navs) in enumerate(_SHOP.values()):
        for j, nav in enumerate(navs):
            changed = (
                "replace(replace(html, '<nav>', '{nav}'), 'href=\"/', 'href=\"{path}')"
            ).format(nav=nav, path=path)
            outside = f'<a href="{path}outside/">o</a>'
            cases.append(
                f"WHEN page_id % 12 = {3 * i + j} THEN '<!-- {marker} -->' || {changed} || '{outside}'"
            )
    return "CASE " + " ".join(cases) + " END"


@query(
    rf"""
WITH shop AS (
  SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS site, page_id % 12 AS k, {_shop_cases()} AS html
  FROM pages
),
listed AS (
  SELECT page_id, site, k, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS a FROM shop
),
scoped AS (
  SELECT page_id, site, k, CASE WHEN k % 3 = 2 THEN a ELSE a[1:len(a) - 1] END AS a FROM listed
),
anchors AS (SELECT page_id, site, k, unnest(a) AS href, generate_subscripts(a, 1) AS ord FROM scoped),
firsts AS (
  SELECT page_id, k, rtrim(split_part(site || href, '?', 1), '/') AS link, min(ord) AS o
  FROM anchors GROUP BY ALL
)
SELECT page_id, ['shopify', 'woocommerce', 'shopyy', 'odoo'][1 + CAST(floor(k / 3) AS INT)] AS platform,
  CASE WHEN k % 3 = 2 THEN 'page' ELSE 'container' END AS scope_used,
  row_number() OVER (PARTITION BY page_id ORDER BY o) AS ordinal, link
FROM firsts"""
)
def container_links(t: Tables) -> DataFrame:
    shop = t.pages.select("page_id", "url", F.expr(_shop_cases()).alias("html"))
    return links.explode_links(links.extract_links(shop, strict=True)).select(
        "page_id", "platform", "scope_used", F.col("ordinal").cast("long").alias("ordinal"), "link"
    )


# Product anchors in the open: navigation bars turned into plain blocks.
_OPEN = "replace(replace(replace(html, '<nav>', '<div>'), '</nav>', '</div>'), 'href=\"/t', 'href=\"/products/t')"


@query(
    rf"""
WITH shop AS (
  SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS site,
    regexp_extract_all({_OPEN}, '<a [^>]*href="([^"]*)"', 1) AS a FROM pages
),
anchors AS (SELECT page_id, site, unnest(a) AS href, generate_subscripts(a, 1) AS ord FROM shop),
firsts AS (
  SELECT page_id, CASE WHEN starts_with(href, 'http') THEN href ELSE site || href END AS link, min(ord) AS o
  FROM anchors WHERE contains(href, '/products/') GROUP BY ALL
)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) AS ordinal, link FROM firsts"""
)
def product_links(t: Tables) -> DataFrame:
    facts = facts_of(t.pages.select("page_id", "url", F.expr(_OPEN).alias("html")))
    return _long(facts.select("page_id", F.col("product_links").alias("links")))


@query(
    f"""
SELECT {sql_domain('url')} AS domain, count(*) AS n_pages,
  count(*) FILTER (starts_with(url, 'https')) AS n_secure
FROM pages GROUP BY ALL"""
)
def domain_rollup(t: Tables) -> DataFrame:
    return (
        t.pages.groupBy(urls.domain(F.col("url")).alias("domain"))
        .agg(
            F.count(F.lit(1)).alias("n_pages"),
            F.count_if(F.col("url").startswith("https")).alias("n_secure"),
        )
    )


_ADDRESS = """CASE page_id % 5 WHEN 0 THEN regexp_replace(url, '^https?://', '') WHEN 1 THEN upper(url)
  WHEN 2 THEN 'no address' WHEN 3 THEN replace(url, '://', '://me:pw@') ELSE ' ' || url || ' ' END"""


@query(
    rf"""
WITH a AS (SELECT page_id, {_ADDRESS} AS u FROM pages)
SELECT page_id, {sql_domain('u')} AS domain,
  nullif(lower(regexp_extract({sql_strip('u')}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#\s]+)(?:[/:?#]|$)', 1)), '') AS strict_domain,
  starts_with(u, 'http') AS is_url
FROM a"""
)
def url_domains(t: Tables) -> DataFrame:
    u = F.expr(_ADDRESS)
    return t.pages.select(
        "page_id",
        urls.domain(u).alias("domain"),
        urls.strict_domain(u).alias("strict_domain"),
        urls.looks_like_url(u).alias("is_url"),
    )


@query(
    """
SELECT url AS collection_url, CAST(p AS BIGINT) AS page_no,
  url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END
  || CASE WHEN page_id % 2 = 0 THEN 'paged' ELSE 'page' END || '=' || CAST(p AS VARCHAR) AS page_url
FROM pages, generate_series(1, 20) AS s(p)"""
)
def page_frontier(t: Tables) -> DataFrame:
    collections = t.pages.select(
        F.col("url").alias("collection_url"),
        F.when(F.col("page_id") % 2 == 0, "woocommerce").otherwise("shopify").alias("platform"),
    )
    return paging.frontier(collections).select(
        "collection_url", F.col("page_no").cast("long").alias("page_no"), "page_url"
    )


# Customers as collections, their orders dealt onto numbered pages, parts as links.
# One query shows the bound on pages; the others read all of them.
_FEW = 5
_ALL = rules.MAX_LISTING_PAGES


def _listing(most: int) -> str:
    return f"""listing AS (
  SELECT o_custkey AS collection, o_orderkey % 6 + 1 AS page_no, min(o_orderkey) % 4 <> 0 AS has_next
  FROM orders GROUP BY ALL
),
items AS (
  SELECT o_custkey AS collection, o_orderkey % 6 + 1 AS page_no, l_linenumber AS ord,
    'part-' || CAST(l_partkey AS VARCHAR) AS link
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
),
bounded AS (SELECT * FROM items WHERE page_no <= {most}),
seen AS (
  SELECT collection, link, min((page_no, ord)) AS p FROM bounded GROUP BY ALL
),
news AS (SELECT collection, p[1] AS page_no, count(*) AS n FROM seen GROUP BY ALL),
starts AS (
  SELECT DISTINCT collection, 1 AS page_no FROM listing WHERE page_no <= {most}
  UNION ALL SELECT collection, page_no + 1 FROM news
),
stops AS (
  SELECT s.collection, min(s.page_no) AS stop_page FROM starts s
  WHERE NOT EXISTS (SELECT 1 FROM news n WHERE n.collection = s.collection AND n.page_no = s.page_no)
  GROUP BY ALL
)"""


_LISTING = _listing(_ALL)
_KEPT = """kept AS (
  SELECT s.collection, s.p[1] AS page_no, s.p[2] AS ord, s.link
  FROM seen s JOIN stops t ON t.collection = s.collection AND s.p[1] < t.stop_page
)"""


def _page_of() -> Column:
    return (F.col("o_orderkey") % 6 + 1).cast("int").alias("page_no")


def _dealt(t: Tables, clicked: bool = False, most: int = _ALL) -> tuple[DataFrame, DataFrame]:
    orders = t.orders.select(F.col("o_custkey").alias("collection_url"), "o_orderkey", _page_of())
    items = orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "collection_url",
        "page_no",
        F.col("l_linenumber").alias("ordinal"),
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("link"),
    )
    counts = items.groupBy("collection_url", "page_no").agg(F.count(F.lit(1)).alias("n_links"))
    pages = (
        orders.groupBy("collection_url", "page_no")
        .agg((F.min("o_orderkey") % 4 != 0).alias("has_next"))
        .join(counts, ["collection_url", "page_no"], "left")
        .select("collection_url", "page_no", F.lit(False).alias("empty"), "has_next", "n_links")
    )
    return paging.paged_links(items, pages, most, clicked)


@query(
    f"""
WITH {_LISTING}, {_KEPT},
per_page AS (SELECT collection, page_no, count(*) AS new_links FROM kept GROUP BY ALL)
SELECT collection, CAST(page_no AS BIGINT) AS page_no, new_links,
  CAST(sum(new_links) OVER (PARTITION BY collection ORDER BY page_no) AS BIGINT) AS total_links
FROM per_page"""
)
def paging_stop(t: Tables) -> DataFrame:
    kept, _ = _dealt(t)
    return paging.page_totals(kept).select(
        F.col("collection_url").alias("collection"),
        F.col("page_no").cast("long").alias("page_no"),
        "new_links",
        "total_links",
    )


def _reason(most: int) -> str:
    return f"""CASE WHEN stop_page > {most} THEN 'max_pages'
    WHEN l.collection IS NULL THEN 'empty'
    WHEN NOT EXISTS (SELECT 1 FROM bounded b WHERE b.collection = t.collection AND b.page_no = t.stop_page) THEN 'no_links'
    ELSE 'no_new' END"""


@query(
    f"""
WITH {_listing(_FEW)}
SELECT t.collection, CAST(t.stop_page AS BIGINT) AS stop_page, {_reason(_FEW)} AS stop_reason
FROM stops t LEFT JOIN listing l ON l.collection = t.collection AND l.page_no = t.stop_page"""
)
def paging_stop_reason(t: Tables) -> DataFrame:
    _, stops = _dealt(t, most=_FEW)
    return stops.select(
        F.col("collection_url").alias("collection"),
        F.col("stop_page").cast("long").alias("stop_page"),
        "stop_reason",
    )


@query(
    f"""
WITH {_LISTING},
plain AS (
  SELECT t.collection, t.stop_page, replace({_reason(_ALL)}, 'empty', 'no_links') AS why
  FROM stops t LEFT JOIN listing l ON l.collection = t.collection AND l.page_no = t.stop_page
),
ends AS (SELECT collection, min(page_no) + 1 AS e FROM listing WHERE NOT has_next AND page_no <= {_ALL} GROUP BY ALL)
SELECT collection, CAST(CASE WHEN e <= stop_page THEN e ELSE stop_page END AS BIGINT) AS stop_page,
  CASE WHEN e <= stop_page THEN 'no_next' ELSE why END AS stop_reason
FROM plain LEFT JOIN ends USING (collection)"""
)
def paging_clicked(t: Tables) -> DataFrame:
    _, stops = _dealt(t, clicked=True)
    return stops.select(
        F.col("collection_url").alias("collection"),
        F.col("stop_page").cast("long").alias("stop_page"),
        "stop_reason",
    )


_NUMBERED = f"""
WITH {_LISTING}, {_KEPT}
SELECT collection, row_number() OVER (PARTITION BY collection ORDER BY page_no, ord, link) AS seq, link FROM kept"""


@query(_NUMBERED)
def paging_links(t: Tables) -> DataFrame:
    kept, _ = _dealt(t)
    return paging.with_sequence(kept).select(
        F.col("collection_url").alias("collection"), "seq", "link"
    )


@query(f"WITH {_LISTING}, {_KEPT} SELECT collection, count(*) AS n_links FROM kept GROUP BY ALL")
def paging_total(t: Tables) -> DataFrame:
    kept, _ = _dealt(t)
    return paging.total_links(kept).withColumnRenamed("collection_url", "collection")


@query(
    f"""
WITH {_LISTING}, {_KEPT}
SELECT collection, CAST(page_no AS BIGINT) AS page_no, link FROM kept ORDER BY collection, page_no, link LIMIT 5"""
)
def first_n_preview(t: Tables) -> DataFrame:
    kept, _ = _dealt(t)
    return paging.first_rows(kept, ["collection_url", "page_no", "link"]).select(
        F.col("collection_url").alias("collection"), F.col("page_no").cast("long").alias("page_no"), "link"
    )


@query(
    f"""
WITH {_HREFS},
firsts AS (SELECT href AS link, min((page_id, ord)) AS p FROM anchors GROUP BY href)
SELECT row_number() OVER (ORDER BY p) AS seq, link AS product_url FROM firsts"""
)
def links_csv(t: Tables) -> DataFrame:
    """Written as CSV to the shared folder and read back."""
    path = new_path(t.spark, "links-csv")
    write_links(links_global_first(t), path)
    read = t.spark.read.option("header", True).schema(
        f"`{SEQUENCE_HEADER}` LONG, product_url STRING"
    ).csv(path)
    return read.select(F.col(SEQUENCE_HEADER).alias("seq"), "product_url")


@query(
    """
SELECT DISTINCT l_partkey AS link FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)"""
)
def new_items_anti(t: Tables) -> DataFrame:
    found = t.lineitem.select(F.col("l_partkey").alias("link")).distinct()
    known = t.part.where(F.col("p_size") > 10).select(F.col("p_partkey").alias("link"))
    return links.not_yet_known(found, known)


@query(
    """
SELECT CAST(min(l_orderkey % 3) AS BIGINT) AS increment, 'https://x.example/products/' || CAST(l_partkey AS VARCHAR) AS link
FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10) GROUP BY l_partkey"""
)
def links_incremental(t: Tables) -> DataFrame:
    """Known links, and three crawls put in one after the other, the second one twice."""
    folder = new_path(t.spark, "known-links")
    known_links.create(t.spark, folder, 64)

    def link(key: str) -> Column:
        return F.concat(F.lit("https://x.example/products/"), F.col(key).cast("string")).alias("link")

    known_links.add(t.spark, folder, t.part.where("p_size > 10").select(link("p_partkey")), "known")
    out = None
    for number in (0, 1, 1, 2):
        found = t.lineitem.where(F.col("l_orderkey") % 3 == number).select(link("l_partkey"))
        new = known_links.add(t.spark, folder, found, f"crawl-{number}").select(F.lit(number).cast("long").alias("increment"), "link")
        out = new if out is None else out.unionByName(new)
    return out.distinct()
