"""The registered queries of this subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyloom.llm import collocations, decontamination, exact_dedup, language, line_dedup, near_dedup
from copyloom.llm import packing, pii, sharding, spelling, token_files, toxicity, url_filter
from copyloom.llm.common import held_out, share, table
from copyloom.plans.workdir import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"))


@query
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as a token folder and read back."""
    path = new_path(spark, "token-files")
    token_files.write_tokens(table(spark, folder, "documents"), path)
    return token_files.read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, taken as two ingests: one is the snapshot, the other arrives."""
    docs = table(spark, folder, "documents")
    return exact_dedup.exact_dedup(docs, share(6, F.col("doc_id")) < 0.5)


SQL["op6_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_dedup.near_dedup(table(spark, folder, "documents"))


@query
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in all documents."""
    found = decontamination.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        "contaminated",
    )


SQL["op2_decontamination"] = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, ws[p:p + least(10, len(ws)) - 1] AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM item WHERE len(ws) > 0)
), sizes AS (
  SELECT DISTINCT len(win) AS n FROM item_window
), place AS (
  SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM doc, sizes WHERE len(ws) >= n
), hit AS (
  SELECT doc_id, p, n, item_id FROM place JOIN item_window ON ws[p:p + n - 1] = win
), covered AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS w FROM (SELECT DISTINCT doc_id, p, n FROM hit))
  GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit WHERE item_id IS NOT NULL)
  GROUP BY doc_id
)
SELECT doc.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


#: The rules of the url query.
URL_RULES = [
    url_filter.Rule("net/", "block"),
    url_filter.Rule("example.net/en/", "allow"),
    url_filter.Rule("example.com/de/", "block"),
    url_filter.Rule("org/fr/", "allow"),
]


@query
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """All page urls, by rule, or else by a model of the urls that the rules decide."""
    pages = table(spark, folder, "pages")
    model = url_filter.fit(url_filter.labels_from_rules(pages, URL_RULES))
    return url_filter.judged(pages, URL_RULES, model)


@query
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, folder, "documents")
    model = language.fit(docs)
    return language.detected(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_accepted").alias("accepted"),
    )


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score of every document."""
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


#: Shards of the placement query.
SHARDS = [f"shard-{i:03d}" for i in range(96)]


@query
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every document."""
    docs = table(spark, folder, "documents").select("doc_id")
    return sharding.placed(docs, "doc_id", SHARDS).select(
        "doc_id", F.col("slot").cast("bigint").alias("slot"), "shard"
    )


@query
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without passages of several lines that occurred before."""
    cleaned = line_dedup.passage_dedup(table(spark, folder, "documents"))
    return cleaned.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


@query
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with the frequent word that each is a variant of."""
    return spelling.variants(table(spark, folder, "documents"))


@query
def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents: counts of what the rules find, and all spans."""
    docs = table(spark, folder, "documents")
    found = pii.found(docs, pii.fit(docs))

    def written(spans: str) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


@query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of two and three words of each language."""
    return collocations.collocations(table(spark, folder, "documents"))


SQL["op13_collocations"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM piece
), place AS (
  SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS pos
  FROM listed, (SELECT unnest([1, 2, 3]) AS m) WHERE len(ws) >= m
), counted AS (
  SELECT lang, ws[pos:pos + m - 1] AS ph, m, count(*) AS f FROM place GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE m = 1 GROUP BY lang
), often AS (
  SELECT * FROM counted WHERE f >= 10
), inner_part AS (
  SELECT lang, ph[s:s + 1] AS ph, max(f) AS longer
  FROM (SELECT *, unnest([1, 2]) AS s FROM often WHERE m = 3) GROUP BY ALL
), candidate AS (
  SELECT o.* FROM often o LEFT JOIN inner_part i USING (lang, ph)
  WHERE m = 3 OR m = 2 AND (longer IS NULL OR 100 * longer < 50 * f)
), cut AS (
  SELECT c.lang, c.ph, c.f AS a, k, l.f AS l, r.f AS r,
         (1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidate) c
  JOIN often l ON l.lang = c.lang AND l.ph = c.ph[1:k]
  JOIN often r ON r.lang = c.lang AND r.ph = c.ph[k + 1:]
), lowest AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1
), ranked AS (
  SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank
  FROM lowest
)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
