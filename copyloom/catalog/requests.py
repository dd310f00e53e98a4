"""Requests, bundles, contexts and prompts over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom import rules
from copyloom.catalog import Tables, query, sql_parts, sql_squeeze, sql_strip
from copyloom.functions import text as tx
from copyloom.operators import bundle as bundles
from copyloom.operators import context as contexts
from copyloom.operators import prompt as prompts
from copyloom.operators import requests as reqs
from copyloom.operators.pages import page_facts
from copyloom.plans.workdir import new_path
from copyloom.sources import fact_store
from copyloom.sources.snapshots import requests_from_json

# -- forms ------------------------------------------------------------------

_FORM = {
    "request_id": "c_custkey",
    "brand_name": "'  ' || c_name || ' '",
    "website_url": "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'https://shop' || CAST(c_custkey AS VARCHAR) || '.example' END",
    "collection_url": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'https://shop.example/c/' || CAST(c_custkey AS VARCHAR) END",
    "collection_topic": "c_mktsegment",
    "target_market": "CASE WHEN c_nationkey < 3 THEN ' ' ELSE CAST(c_nationkey AS VARCHAR) END",
    "keywords": "lower(c_mktsegment) || ', gifts'",
    "competitor_urls": "CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' https://a.example ' || chr(10) || ' ' ELSE 'https://a.example' || chr(10) || chr(10) || 'https://b.example/' || CAST(c_custkey AS VARCHAR) END",
    "product_links": "CASE c_custkey % 4 WHEN 0 THEN 'https://p.example/1' || chr(10) || 'https://p.example/2' ELSE '' END",
    "brand_info": "CASE WHEN c_acctbal < 0 THEN '' ELSE 'balance ' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END",
    "output_language": "CASE c_custkey % 5 WHEN 0 THEN 'custom' WHEN 1 THEN NULL WHEN 2 THEN 'French' ELSE 'English' END",
    "custom_language": "CASE c_custkey % 10 WHEN 0 THEN ' Polish ' ELSE ' ' END",
}
_FORM_SQL = "raw AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _FORM.items()) + " FROM customer)"
_SINGLE = ("brand_name", "website_url", "collection_url", "collection_topic", "target_market", "keywords", "brand_info")
_VALUES_SQL = f"""{_FORM_SQL},
forms AS (SELECT request_id, {', '.join(f"{sql_strip(f'coalesce({c}, {chr(39) * 2})')} AS {c}" for c in _SINGLE)},
  {sql_parts('competitor_urls', chr(92) + 'n')} AS competitor_urls,
  {sql_parts('product_links', chr(92) + 'n')} AS product_links,
  CASE WHEN output_language = 'custom' THEN coalesce(nullif({sql_strip('custom_language')}, ''), 'English')
    ELSE coalesce(output_language, 'English') END AS output_language
FROM raw)"""


def _forms(t: Tables) -> DataFrame:
    raw = t.customer.select(
        *[F.expr(e.replace("VARCHAR", "STRING")).alias(n) for n, e in _FORM.items()]
    )
    return reqs.form_values(raw)


@query(
    f"""
WITH {_VALUES_SQL}
SELECT request_id, brand_name, website_url, target_market, output_language,
  array_to_string(competitor_urls, '|') AS competitor_urls, array_to_string(product_links, '|') AS product_links
FROM forms"""
)
def form_values(t: Tables) -> DataFrame:
    return _forms(t).select(
        "request_id", "brand_name", "website_url", "target_market", "output_language",
        F.array_join("competitor_urls", "|").alias("competitor_urls"),
        F.array_join("product_links", "|").alias("product_links"),
    )


@query(
    f"""
WITH {_VALUES_SQL},
m AS (SELECT request_id, list_filter([{', '.join(f"CASE WHEN {c} = {chr(39) * 2} THEN {chr(39)}{c}{chr(39)} END" for c in rules.REQUIRED_FIELDS)}],
  lambda v: v IS NOT NULL) AS missing FROM forms)
SELECT request_id, array_to_string(missing, ',') AS missing, len(missing) = 0 AS valid FROM m"""
)
def required_fields(t: Tables) -> DataFrame:
    return reqs.validated(_forms(t)).select(
        "request_id", F.array_join("missing", ",").alias("missing"), "valid"
    )


@query(
    f"""
WITH {_VALUES_SQL}
SELECT CASE WHEN collection_url <> '' THEN 'accepted' ELSE 'rejected' END AS side, count(*) AS n
FROM forms GROUP BY ALL"""
)
def request_sides(t: Tables) -> DataFrame:
    accepted, rejected = reqs.split_by_address(_forms(t))

    def counted(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(F.lit(side).alias("side")).agg(F.count(F.lit(1)).alias("n"))

    return counted(accepted, "accepted").unionByName(counted(rejected, "rejected"))


@query(
    f"""
WITH {_VALUES_SQL},
ok AS (SELECT * FROM forms WHERE collection_url <> '')
SELECT request_id, 'brand' AS role, CAST(1 AS BIGINT) AS ordinal, website_url AS url FROM ok WHERE website_url <> ''
UNION ALL SELECT request_id, 'collection', 1, collection_url FROM ok
UNION ALL SELECT request_id, 'competitor', generate_subscripts(competitor_urls, 1), unnest(competitor_urls) FROM ok"""
)
def request_parts(t: Tables) -> DataFrame:
    return reqs.request_parts(_forms(t)).select(
        "request_id", "role", F.col("ordinal").cast("long").alias("ordinal"), "url"
    )


@query(
    f"""
WITH {_VALUES_SQL}
SELECT request_id, brand_name, keywords, output_language, len(competitor_urls) AS n_competitors FROM forms"""
)
def requests_json(t: Tables) -> DataFrame:
    """Requests written as JSON text and read back with the fixed schema."""
    bodies = _forms(t).select(F.to_json(F.struct("*")).alias("body"))
    return requests_from_json(bodies, F.col("body")).select(
        "request_id", "brand_name", "keywords", "output_language",
        F.size("competitor_urls").cast("long").alias("n_competitors"),
    )


# -- bundles ----------------------------------------------------------------

@query(
    rf"""
WITH req AS (
  SELECT p.page_id AS request_id, p.url AS collection_url,
    CASE WHEN p.page_id % 3 = 0 THEN 'https://hot.example/' WHEN p.page_id % 3 = 1 THEN n.url END AS website_url,
    [' ' || n.url || ' ', '  ', 'https://missing.example/' || CAST(p.page_id AS VARCHAR)] AS c
  FROM pages p LEFT JOIN pages n ON n.page_id = p.page_id + 1
),
competitors AS (
  SELECT request_id, list_filter(list_transform(c, lambda v: {sql_strip('v')}), lambda v: v <> '') AS c FROM req
),
parts AS (
  SELECT request_id, 'brand' AS role, 1 AS ordinal, website_url AS url FROM req WHERE website_url <> ''
  UNION ALL SELECT request_id, 'collection', 1, collection_url FROM req
  UNION ALL SELECT request_id, 'competitor', generate_subscripts(c, 1), unnest(c) FROM competitors
)
SELECT r.request_id, r.role, CAST(r.ordinal AS BIGINT) AS ordinal, r.url, p.url IS NOT NULL AS success,
  CASE WHEN p.url IS NULL THEN 'not in snapshot' END AS error,
  {sql_strip("regexp_replace(replace(regexp_extract(p.html, '(?is)<title[^>]*>(.*?)</title>', 1), '&quot;', '\"'), '&amp;?', '&', 'g')")} AS title
FROM parts r LEFT JOIN pages p ON p.url = r.url"""
)
def request_bundle(t: Tables) -> DataFrame:
    """Each page as a request that names the next page and a missing one as competitors."""
    near = t.pages.select((F.col("page_id") - 1).alias("request_id"), F.col("url").alias("next_url"))
    requests = (
        t.pages.select(F.col("page_id").alias("request_id"), F.col("url").alias("collection_url"))
        .join(near, "request_id", "left")
        .select(
            "request_id",
            "collection_url",
            F.when(F.col("request_id") % 3 == 0, "https://hot.example/")
            .when(F.col("request_id") % 3 == 1, F.col("next_url"))
            .alias("website_url"),
            F.array(
                F.concat(F.lit(" "), "next_url", F.lit(" ")),
                F.lit("  "),
                F.concat(F.lit("https://missing.example/"), F.col("request_id").cast("string")),
            ).alias("competitor_urls"),
        )
    )
    folder = new_path(t.spark, "facts")
    fact_store.write_facts(bundles.facts_by_url(page_facts(t.pages), t.pages), folder)
    return fact_store.attached(reqs.request_parts(requests), folder).select(
        "request_id", "role", F.col("ordinal").cast("long").alias("ordinal"), "url", "success", "error", "title"
    )


_LINKS = "transform(sequence(0, cast(o_orderkey % 36 as int)), i -> concat('https://s.example/products/', (o_custkey * 7 + i * 13) % 2500))"


@query(
    """
WITH c AS (
  SELECT o_orderkey AS request_id, list_transform(range(0, o_orderkey % 36 + 1),
    lambda i: 'https://s.example/products/' || CAST((o_custkey * 7 + i * 13) % 2500 AS VARCHAR)) AS links
  FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT'
),
x AS (SELECT request_id, unnest(links) AS url, generate_subscripts(links, 1) AS ordinal FROM c)
SELECT x.request_id, x.ordinal, x.url, p_partkey IS NOT NULL AS success, p_name AS title
FROM x LEFT JOIN part ON 'https://s.example/products/' || CAST(p_partkey AS VARCHAR) = x.url
WHERE x.ordinal <= 30"""
)
def collection_products(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    bundle = t.orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.lit("collection").alias("role"),
        (F.col("o_orderstatus") != "F").alias("success"),
        F.expr(_LINKS).alias("product_links"),
    )
    requests = t.orders.select(
        F.col("o_orderkey").alias("request_id"),
        (F.col("o_orderpriority") == "1-URGENT").alias("skip_products"),
    )
    facts = t.part.select(
        F.concat(F.lit("https://s.example/products/"), F.col("p_partkey").cast("string")).alias("url"),
        F.lit(True).alias("success"),
        none.alias("error"),
        F.col("p_name").alias("title"),
        *[none.alias(c) for c in ("meta_desc", "h1", "body_text")],
        F.array().cast("array<string>").alias("product_links"),
    )
    folder = fact_store.write_facts(facts, new_path(t.spark, "facts"))
    products = fact_store.attached(bundles.product_parts(bundle, requests), folder)
    return products.select(
        "request_id", F.col("ordinal").cast("long").alias("ordinal"), "url", "success", "title"
    )


# Documents as page facts, four to a request; labels as hand-typed replacements.
_DOC_BUNDLE = f"""b AS (
  SELECT CAST(floor(doc_id / 4) AS BIGINT) AS request_id,
    ['brand', 'collection', 'product', 'competitor'][1 + doc_id % 4] AS role, 1 + doc_id % 4 AS role_no,
    'https://d.example/' || CAST(doc_id AS VARCHAR) AS url, doc_id % 5 <> 0 AS success,
    source AS title, lang AS meta_desc, lang AS h1, substr({sql_squeeze('text')}, 1, 8000) AS body, doc_id
  FROM documents
),
o AS (
  SELECT doc_id, CASE WHEN quality = 1 THEN 'typed ' || CAST(doc_id AS VARCHAR) END AS override FROM labels
),
j AS (SELECT b.*, o.override FROM b LEFT JOIN o USING (doc_id))"""


def _role() -> tuple[Column, Column]:
    place = (F.col("doc_id") % 4).cast("int")
    names = F.array(*[F.lit(r) for r in rules.ROLE_NO])
    return F.get(names, place), place + 1


def _request_of() -> Column:
    return F.floor(F.col("doc_id") / 4).alias("request_id")


def _doc_bundle(t: Tables, *columns: str) -> DataFrame:
    role, role_no = _role()
    made = {
        "url": F.concat(F.lit("https://d.example/"), F.col("doc_id").cast("string")),
        "success": F.col("doc_id") % 5 != 0,
        "error": F.lit(None).cast("string"),
        "title": F.col("source"),
        "meta_desc": F.col("lang"),
        "h1": F.col("lang"),
        "body_text": tx.body_text(F.col("text")),
    }
    return t.documents.select(
        _request_of(),
        role.alias("role"),
        role_no.alias("role_no"),
        F.lit(1).alias("ordinal"),
        *[made[c].alias(c) for c in (columns or made)],
    )


def _doc_overrides(t: Tables) -> DataFrame:
    """Two replacements for each place, of which the later one counts; some are blank."""
    role, _ = _role()
    typed = F.concat(F.lit("  typed "), F.col("doc_id").cast("string"), F.lit(" "))
    last = F.when(F.col("quality") == 1, typed).otherwise("  ")
    return t.labels.select(
        _request_of(),
        role.alias("role"),
        F.concat(F.lit("https://d.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.inline(
            F.array(
                F.struct(last.alias("content"), F.lit(2).cast("bigint").alias("version")),
                F.struct(F.lit("earlier").alias("content"), F.lit(1).cast("bigint").alias("version")),
            )
        ),
    )


@query(
    f"""
WITH {_DOC_BUNDLE}
SELECT request_id, role, CASE WHEN success THEN 'facts' ELSE 'override' END AS source,
  CASE WHEN success THEN body ELSE override END AS content
FROM j WHERE success OR override IS NOT NULL"""
)
def override_backfill(t: Tables) -> DataFrame:
    return contexts.backfilled(_doc_bundle(t), _doc_overrides(t)).select(
        "request_id", "role", "source",
        F.when(F.col("success"), F.col("body_text")).otherwise(F.col("override")).alias("content"),
    )


@query(
    f"""
WITH {_DOC_BUNDLE}
SELECT request_id % 50 AS request_id, role, count(*) FILTER (success) AS ok, count(*) AS total,
  CASE WHEN bool_and(success) THEN 'ok' ELSE 'fail' END AS status
FROM b GROUP BY ALL"""
)
def fetch_status(t: Tables) -> DataFrame:
    bundle = _doc_bundle(t, "success").withColumn("request_id", F.col("request_id") % 50)
    return bundles.fetch_status(bundle)


@query(
    f"""
WITH {_DOC_BUNDLE}
SELECT request_id % 50 AS request_id,
  row_number() OVER (PARTITION BY request_id % 50 ORDER BY role_no, url) AS queue_no, role AS type, url
FROM b WHERE NOT success"""
)
def failed_queue(t: Tables) -> DataFrame:
    bundle = _doc_bundle(t, "success", "url").withColumn("request_id", F.col("request_id") % 50)
    return bundles.failed_queue(bundle)


_CONTEXT_SQL = f"""{_DOC_BUNDLE},
s AS (
  SELECT request_id, role_no, CASE role
    WHEN 'brand' THEN CASE WHEN success THEN chr(10) || chr(10) || '## 品牌官网内容（https://w.example/' || CAST(request_id AS VARCHAR) || '）' || chr(10)
        || '标题：' || title || chr(10) || 'Meta描述：' || meta_desc || chr(10) || '正文摘要：' || body || chr(10)
      WHEN override IS NOT NULL THEN chr(10) || chr(10) || '## 品牌官网内容（手动补充）' || chr(10) || override || chr(10) ELSE '' END
    WHEN 'collection' THEN CASE WHEN success THEN chr(10) || chr(10) || '## 集合页内容（https://c.example/' || CAST(request_id AS VARCHAR) || '）' || chr(10)
        || '标题：' || title || chr(10) || 'Meta描述：' || meta_desc || chr(10) || '正文摘要：' || body || chr(10)
      WHEN override IS NOT NULL THEN chr(10) || chr(10) || '## 集合页内容（手动补充）' || chr(10) || override || chr(10) ELSE '' END
    WHEN 'product' THEN chr(10) || chr(10) || '## 产品详情页内容' || chr(10) || CASE
      WHEN success THEN chr(10) || '### 产品 1：' || title || '（' || url || '）' || chr(10) || 'Meta描述：' || meta_desc || chr(10)
        || 'H1：' || h1 || chr(10) || '正文摘要：' || body || chr(10)
      WHEN override IS NOT NULL THEN chr(10) || '### 产品 1（手动补充，' || url || '）' || chr(10) || override || chr(10) ELSE '' END
    ELSE chr(10) || chr(10) || '## 竞品集合页内容' || chr(10) || CASE
      WHEN success THEN chr(10) || '### 竞品 1：' || title || '（' || url || '）' || chr(10) || '正文摘要：' || body || chr(10)
      WHEN override IS NOT NULL THEN chr(10) || '### 竞品 1（手动补充，' || url || '）' || chr(10) || override || chr(10) ELSE '' END
    END AS part
  FROM j
)"""


@query(
    f"""
WITH {_CONTEXT_SQL}
SELECT request_id, string_agg(part, '' ORDER BY role_no)
  || CASE WHEN request_id % 2 = 0 THEN chr(10) || chr(10) || '## 产品链接列表（手动输入）' || chr(10) || '共 2 个产品：' || chr(10)
     || '1. https://p.example/a' || chr(10) || '2. https://p.example/b' || chr(10) ELSE '' END AS context
FROM s GROUP BY request_id"""
)
def context_assembly(t: Tables) -> DataFrame:
    number = F.col("request_id").cast("string")
    two = F.array(F.lit("https://p.example/a"), F.lit("https://p.example/b"))
    requests = (
        t.documents.select(_request_of())
        .distinct()
        .select(
            "request_id",
            F.concat(F.lit("https://w.example/"), number).alias("website_url"),
            F.concat(F.lit("https://c.example/"), number).alias("collection_url"),
            F.when(F.col("request_id") % 2 == 0, two).alias("product_links"),
        )
    )
    return contexts.context(requests, _doc_bundle(t), _doc_overrides(t))


# -- prompts ----------------------------------------------------------------

def _prompt_sql() -> str:
    values = {
        "brand_info": f"coalesce(nullif(brand_info, ''), '{rules.NOT_GIVEN}')",
        "competitor_info": f"CASE WHEN len(competitor_urls) > 0 THEN array_to_string(competitor_urls, ', ') ELSE '{rules.NO_COMPETITORS}' END",
        "product_info": f"CASE WHEN len(product_links) > 0 THEN array_to_string(product_links, ', ') ELSE '{rules.NOT_GIVEN}' END",
        "competitor_list": "array_to_string(competitor_urls, ',')",
    }
    pieces = prompts.SLOT.split(prompts.default_template())
    out = []
    for i, piece in enumerate(pieces):
        out.append("'" + piece.replace("'", "''") + "'" if i % 2 == 0 else values.get(piece, piece))
    return " || ".join(out)


@query(f"WITH {_VALUES_SQL} SELECT request_id, {_prompt_sql()} AS prompt FROM forms")
def prompt_render(t: Tables) -> DataFrame:
    return prompts.prompts(_forms(t))


@query(
    """
SELECT conv_id, turn, 'user' AS role, text, CAST(0.7 AS DOUBLE) AS temperature,
  CAST(65536 AS BIGINT) AS max_tokens, CAST(0.95 AS DOUBLE) AS top_p
FROM conversations"""
)
def request_json(t: Tables) -> DataFrame:
    """Payloads, looked at field by field."""
    body = t.conversations.select("conv_id", "turn", prompts.request_json(F.col("text")).alias("body"))
    field = lambda path: F.get_json_object("body", path)
    return body.select(
        "conv_id", "turn",
        field("$.contents[0].role").alias("role"),
        field("$.contents[0].parts[0].text").alias("text"),
        field("$.generationConfig.temperature").cast("double").alias("temperature"),
        field("$.generationConfig.maxOutputTokens").cast("long").alias("max_tokens"),
        field("$.generationConfig.topP").cast("double").alias("top_p"),
    )
