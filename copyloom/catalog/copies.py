"""Copy checks and history over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom import rules
from copyloom.catalog import Tables, query, sql_parts, sql_strip
from copyloom.functions import keywords as kw
from copyloom.functions import text as tx
from copyloom.operators import history as hist
from copyloom.operators import quality
from copyloom.operators import terms as long_lists
from copyloom.plans.workdir import new_path
from copyloom.sources import history_store

# -- copy checks ------------------------------------------------------------

_WORDS = ["the", "and", "with", "idiot", "der", "los", "oui"]


@query(
    r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS word FROM documents
)
SELECT doc_id, word, count(*) AS n FROM w
WHERE word IN ('the', 'and', 'with', 'idiot', 'der', 'los', 'oui') GROUP BY ALL"""
)
def quality_words(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.inline(quality.word_counts(F.col("text"), _WORDS))
    )


@query(
    r"""
WITH b AS (SELECT doc_id, lower(replace(text, ' the ', ' **the** ')) AS t FROM documents),
k AS (SELECT unnest(['the', 'of', 'THan']) AS keyword)
SELECT doc_id, keyword,
  len(list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}\p{M}_]+'), lambda w: w = lower(keyword))) AS uses,
  CAST((length(t) - length(replace(t, '**' || lower(keyword) || '**', ''))) / (length(keyword) + 4) AS BIGINT) AS bold
FROM b, k"""
)
def quality_bold(t: Tables) -> DataFrame:
    text = F.replace("text", F.lit(" the "), F.lit(" **the** "))
    words = F.array(F.lit("the"), F.lit("of"), F.lit("THan"))
    both = F.arrays_zip(
        quality.word_uses_of_each(text, words).alias("u"),
        quality.occurrences_of_each(text, words, "**").alias("b"),
    )
    return t.documents.select("doc_id", F.explode(both).alias("x")).select(
        "doc_id", F.col("x.u.part").alias("keyword"), F.col("x.u.n").alias("uses"), F.col("x.b.n").alias("bold")
    )


# Names of parts, and the first three words of each benchmark item with the signs that stand at them.
_TERM_WORDS = r"[\p{L}\p{N}\p{M}_]+"
_MOST_WORDS = 8


def _term_grams() -> str:
    """Runs of 1 to `_MOST_WORDS` words, with the gaps between and round them."""
    arms, gram = [], "w0"
    for k in range(1, _MOST_WORDS + 1):
        arms.append(
            f"SELECT doc_id, {gram} AS gram, b0 AS before, a{k - 1} AS after, pos = 1 AS opens,"
            f" pos + {k - 1} = total AS closes FROM x WHERE pos + {k - 1} <= total"
        )
        gram += f" || a{k - 1} || w{k}"
    return " UNION ALL ".join(arms)


@query(
    rf"""
WITH t AS (
  SELECT lower(p_name) AS term FROM part
  UNION SELECT lower(array_to_string(string_split(text, ' ')[1:3], ' ')) FROM benchmark
),
cut AS (
  SELECT term, regexp_extract(term, '^[^\p{{L}}\p{{N}}\p{{M}}_]*') AS lead, regexp_extract(term, '[^\p{{L}}\p{{N}}\p{{M}}_]*$') AS tail
  FROM t WHERE regexp_matches(term, '{_TERM_WORDS}')
),
listed AS (SELECT *, substr(term, length(lead) + 1, length(term) - length(lead) - length(tail)) AS gram FROM cut),
d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '{_TERM_WORDS}') AS w, regexp_split_to_array(lower(text), '{_TERM_WORDS}') AS g
  FROM documents
),
p AS (
  SELECT doc_id, unnest(w) AS w0, unnest(g[1:len(w)]) AS b0, unnest(g[2:]) AS a0, generate_subscripts(w, 1) AS pos, len(w) AS total FROM d
),
x AS (
  SELECT *, {", ".join(f"lead(w0, {k}) OVER o AS w{k}, lead(a0, {k}) OVER o AS a{k}" for k in range(1, _MOST_WORDS))}
  FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
),
grams AS ({_term_grams()})
SELECT doc_id, term, count(*) AS n FROM grams JOIN listed USING (gram)
WHERE ends_with(before, lead) AND (lead = '' OR opens OR length(before) > length(lead))
  AND starts_with(after, tail) AND (tail = '' OR closes OR length(after) > length(tail))
GROUP BY ALL"""
)
def quality_terms(t: Tables) -> DataFrame:
    """Uses of a list of terms that grows with the tables, in all documents."""
    opening = F.array_join(F.slice(F.split("text", " ", -1), 1, 3), " ")
    listed = t.part.select(F.col("p_name").alias("term")).unionByName(t.benchmark.select(opening.alias("term")))
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    return long_lists.term_uses(texts, listed).withColumnRenamed("id", "doc_id")


# Lines of a document as headings of three levels, by their first letter.
_MARKS = (("A-M", "##"), ("N-S", "###"), ("T-Z", "#####"))


def _headed_sql() -> str:
    text = "text"
    for letters, marks in _MARKS:
        text = f"regexp_replace({text}, '\\n([{letters}])', chr(10) || '{marks} \\1', 'g')"
    return text


_LINES_SQL = f"""lines AS (
  SELECT doc_id, string_split({_headed_sql()}, chr(10)) AS l FROM documents
),
numbered AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM lines)"""


def _headed_documents(t: Tables) -> DataFrame:
    text = F.col("text")
    for letters, marks in _MARKS:
        text = F.regexp_replace(text, f"\n([{letters}])", f"\n{marks} $1")
    return t.documents.select("doc_id", text.alias("text"))


@query(
    rf"""
WITH {_LINES_SQL},
h AS (
  SELECT doc_id, pos, length(regexp_extract(line, '^(#{{1,6}})\s', 1)) AS level,
    regexp_extract(line, '^#{{1,6}}\s+(.*)$', 1) AS title
  FROM numbered WHERE regexp_matches(line, '^#{{1,6}}\s')
),
b AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY doc_id ORDER BY pos), 1) AS before FROM h)
SELECT doc_id, title, CAST(level AS BIGINT) AS level, CAST(before AS BIGINT) AS before FROM b WHERE level > before + 1"""
)
def quality_headings(t: Tables) -> DataFrame:
    jumps = quality.heading_jumps(quality.headings(F.col("text")))
    return _headed_documents(t).select("doc_id", F.inline(jumps)).select(
        "doc_id", "title", F.col("level").cast("long").alias("level"), F.col("before").cast("long").alias("before")
    )


@query(
    rf"""
WITH {_LINES_SQL},
p AS (
  SELECT doc_id, arg_min(line, pos) AS line FROM numbered
  WHERE {sql_strip('line')} <> '' AND NOT regexp_matches(line, '^#{{1,6}}\s') GROUP BY doc_id
)
SELECT doc_id, line AS paragraph, regexp_matches(line, '(?i)^[\s*_]*(the|in|la)([^\p{{L}}\p{{N}}\p{{M}}_]|$)') AS flagged FROM p"""
)
def quality_opening(t: Tables) -> DataFrame:
    first = _headed_documents(t).select(
        "doc_id", quality.first_paragraph(F.col("text")).alias("paragraph")
    )
    return first.where(F.col("paragraph").isNotNull()).withColumn(
        "flagged", quality.opens_with(F.col("paragraph"), ["the", "in", "la"])
    )


@query(
    r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
n AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM l)
SELECT doc_id, CAST(pos AS BIGINT) AS pos,
  len(list_filter(string_split_regex(line, '\s+'), lambda w: w <> '')) AS words FROM n"""
)
def quality_lengths(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("pos"), quality.word_count(F.col("line")).alias("words")
    )


_FAQ = f"## {rules.FAQ_HEADING} about X"


@query(
    r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
n AS (SELECT doc_id, unnest(l) AS line FROM l),
w AS (SELECT doc_id, len(list_filter(string_split_regex(line, '\s+'), lambda w: w <> '')) AS words FROM n)
SELECT doc_id, count(*) AS n_questions, count(*) FILTER (words < 40 OR words > 80) AS n_bad, sum(words)::BIGINT AS words
FROM w GROUP BY doc_id"""
)
def quality_faq(t: Tables) -> DataFrame:
    """Each line of a document as the answer to a question of its FAQ part."""
    text = F.concat(
        F.lit(f"# T\nintro\n{_FAQ}\n### q\n"),
        F.replace("text", F.lit("\n"), F.lit("\n### q\n")),
        F.lit("\n## Behind\n### not a question\nmore"),
    )
    shaped = t.documents.select("doc_id", text.alias("text"))
    answered = shaped.select("doc_id", quality.faq_answers(F.col("text")).alias("faq"))
    ok = lambda a: a.words.between(rules.MIN_ANSWER_WORDS, rules.MAX_ANSWER_WORDS)
    return answered.select(
        "doc_id",
        F.size("faq").cast("long").alias("n_questions"),
        F.size(F.filter("faq", lambda a: ~ok(a))).cast("long").alias("n_bad"),
        F.aggregate("faq", F.lit(0).cast("long"), lambda s, a: s + a.words).alias("words"),
    )


@query(
    """
WITH c AS (SELECT doc_id, unnest(['Compatibility', 'Installation & Usage', 'Purchase Decision', 'Use Cases',
  'Competitor Comparison', 'Trust & Safety']) AS category, unnest(range(6)) AS i FROM documents)
SELECT doc_id, category FROM c WHERE (doc_id + i) % 4 < 2"""
)
def quality_coverage(t: Tables) -> DataFrame:
    """A coverage table behind each document, with rows missing or failed."""
    names = F.array(*[F.lit(c) for c in rules.FAQ_CATEGORIES])
    rows = F.transform(
        names,
        lambda c, i: F.when((F.col("doc_id") + i) % 4 == 0, F.lit("none"))
        .when((F.col("doc_id") + i) % 4 == 1, F.concat(c, F.lit("\t❌\tQ1")))
        .otherwise(F.concat(c, F.lit("\t ✅\tQ2"))),
    )
    text = F.concat("text", F.lit("\n" + rules.FAQ_TABLE_TITLE + "\n"), F.array_join(rows, "\n"))
    shaped = t.documents.select("doc_id", text.alias("text"))
    return shaped.select("doc_id", F.explode(quality.uncovered_categories(quality.covered_categories(F.col("text")))).alias("category"))


@query(
    """
SELECT doc_id, unnest(CASE doc_id % 4 WHEN 1 THEN ['module_missing'] WHEN 2 THEN ['module_order']
  WHEN 3 THEN ['module_missing', 'module_missing', 'module_missing', 'module_missing'] END) AS "check",
  unnest(CASE doc_id % 4 WHEN 1 THEN ['📚 数据来源列表'] WHEN 2 THEN ['📝 中文对照版|📝 Collection Page Copy|📚 数据来源列表|✅ 最终自检清单']
  WHEN 3 THEN ['📝 Collection Page Copy', '📝 中文对照版', '📚 数据来源列表', '✅ 最终自检清单'] END) AS detail
FROM documents WHERE doc_id % 4 <> 0"""
)
def quality_modules(t: Tables) -> DataFrame:
    """Documents between the four module headings: complete, one missing, swapped, none."""
    heads = [F.lit(f"\n## {h} X\n") for h in rules.MODULE_HEADINGS]
    text, kind = F.col("text"), F.col("doc_id") % 4
    shaped = (
        F.when(kind == 0, F.concat(heads[0], text, heads[1], text, heads[2], heads[3]))
        .when(kind == 1, F.concat(heads[0], text, heads[1], text, heads[3]))
        .when(kind == 2, F.concat(heads[1], text, heads[0], text, heads[2], heads[3]))
        .otherwise(text)
    )
    places = t.documents.select("doc_id", quality.module_places(shaped).alias("places"))
    return places.select("doc_id", F.inline(quality.module_issues(F.col("places"))).alias("check", "detail", "n")).drop("n")


@query(
    rf"""
WITH l AS (
  SELECT doc_id, unnest(list_filter(string_split(replace(text, '. ', ' | https://s.example | '), chr(10)),
    lambda v: {sql_strip('v')} <> '')) AS line FROM documents
)
SELECT doc_id, count(*) AS n_rows,
  count(*) FILTER (len(string_split(line, '|')) = 3 AND regexp_matches({sql_strip("string_split(line, '|')[2]")}, '^https?://')) AS n_good
FROM l GROUP BY doc_id"""
)
def quality_sources(t: Tables) -> DataFrame:
    """Lines of each document as rows of its source list."""
    rows = F.replace("text", F.lit(". "), F.lit(" | https://s.example | "))
    text = F.concat(F.lit("intro | x\n## 📚 数据来源列表\n"), rows, F.lit("\n## ✅ end\na | b"))
    listed = t.documents.select("doc_id", quality.source_rows(text).alias("rows"))
    return listed.select(
        "doc_id",
        F.size("rows").cast("long").alias("n_rows"),
        F.size(F.filter("rows", quality.is_source_row)).cast("long").alias("n_good"),
    )


@query(
    """
SELECT doc_id, len(regexp_extract_all(replace(text, ' the', ' [unverified]'), '\\[unverified\\]')) AS n_marks FROM documents"""
)
def quality_unverified(t: Tables) -> DataFrame:
    text = F.replace("text", F.lit(" the"), F.lit(" [Unverified]"))
    return t.documents.select(
        "doc_id", quality.occurrences(text, F.lit(rules.UNVERIFIED_MARK)).alias("n_marks")
    )


# The longest words of a whole text as its keywords, as many as its id says.
_LONGEST = "slice(reverse(array_sort(transform(array_distinct(filter(split(lower(text), '[^a-z]+'), w -> w <> '')), w -> struct(length(w) AS n, w AS w)))), 1, cast(doc_id % 12 as int))"
_KEYWORDS = f"transform({_LONGEST}, s -> s.w)"
_KEYWORDS_SQL = (
    "list_transform(list_reverse_sort(list_transform(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'),"
    " lambda w: w <> '')), lambda w: {{'n': length(w), 'w': w}}))[1:doc_id % 12], lambda s: s.w)"
).replace("{{", "{").replace("}}", "}")


@query(
    rf"""
WITH k AS (SELECT doc_id, lower(text) AS t, {_KEYWORDS_SQL} AS kws FROM documents),
w AS (SELECT doc_id, lower(u) AS word, count(*) AS uses FROM
  (SELECT doc_id, unnest(regexp_split_to_array(t, '[^\p{{L}}\p{{N}}\p{{M}}_]+')) AS u FROM k) GROUP BY ALL),
x AS (SELECT doc_id, t, kws, unnest(kws) AS kw FROM k),
c AS (
  SELECT x.doc_id, kw, coalesce(w.uses, 0) AS uses,
    CAST((length(t) - length(replace(t, '**' || lower(kw) || '**', ''))) / (length(kw) + 4) AS BIGINT) AS bold
  FROM x LEFT JOIN w ON w.doc_id = x.doc_id AND w.word = kw
)
SELECT 'keyword_overused' AS "check", count(*) AS n_rows, sum(uses)::BIGINT AS n FROM c WHERE uses > 3
UNION ALL SELECT 'keyword_bold', count(*), sum(bold)::BIGINT FROM c WHERE bold NOT BETWEEN 1 AND 3
UNION ALL SELECT 'keyword_count', count(*), sum(len(kws))::BIGINT FROM k WHERE len(kws) NOT BETWEEN 5 AND 10
UNION ALL SELECT 'faq_missing', count(*), 0 FROM documents
UNION ALL SELECT 'faq_category', 6 * count(*), 0 FROM documents
UNION ALL SELECT 'module_missing', 4 * count(*), 0 FROM documents"""
)
def copy_checks(t: Tables) -> DataFrame:
    """All checks in one pass over the documents, counted per check."""
    keywords = F.expr(_KEYWORDS)
    texts = t.documents.select(F.col("doc_id").alias("id"), "text", keywords.alias("keywords"))
    return quality.check_texts(texts).groupBy("check").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n")
    )


# -- history ------------------------------------------------------------------

# Each event saves a record for the domain of its user; the last one stays.

def _records(t: Tables) -> DataFrame:
    return t.events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example")).alias("domain"),
        F.col("event_type").alias("brand_name"),
        F.to_date("ts").alias("last_updated"),
        F.struct("ts", "event_id").alias("version"),
        "event_id",
    )


_RECORDS_SQL = """records AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) || '.example' AS domain, event_type AS brand_name, CAST(ts AS DATE) AS last_updated,
    event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events
)"""


@query(f"WITH {_RECORDS_SQL} SELECT domain, brand_name, last_updated, event_id FROM records WHERE r = 1")
def history_latest(t: Tables) -> DataFrame:
    return hist.latest_records(_records(t)).select("domain", "brand_name", "last_updated", "event_id")


@query(
    """
WITH e AS (SELECT 'u' || CAST(user_id AS VARCHAR) || '.example' AS domain, event_type, CAST(ts AS DATE) AS d, event_id, event_id % 2 AS new FROM events),
old AS (SELECT domain, max(event_id) AS first_saved FROM e WHERE new = 0 GROUP BY domain),
fresh AS (SELECT domain, min(event_id) AS first_saved FROM e WHERE new = 1 GROUP BY domain),
latest AS (SELECT domain, arg_max(event_type, event_id) AS brand_name, arg_max(d, event_id) AS last_updated, max(event_id) AS version FROM e GROUP BY domain)
SELECT domain, brand_name, last_updated, version, least(o.first_saved, f.first_saved) AS first_saved
FROM latest LEFT JOIN old o USING (domain) LEFT JOIN fresh f USING (domain)"""
)
def history_upsert(t: Tables) -> DataFrame:
    """Even events are the stored history, odd ones are put in."""
    rows = _records(t).select("domain", "brand_name", "last_updated", F.col("event_id").alias("version"))
    even = F.col("version") % 2 == 0
    stored = hist.latest_records(rows.where(even)).withColumn("first_saved", F.col("version"))
    return hist.upsert(stored, rows.where(~even)).select(
        "domain", "brand_name", "last_updated", "version", "first_saved"
    )


@query(
    """
WITH e AS (SELECT 'u' || CAST(user_id AS VARCHAR) || '.example' AS domain, event_type, event_id, event_id % 3 + 1 AS batch FROM events),
v AS (SELECT * FROM (VALUES (1), (2), (3)) AS v(saved))
SELECT CAST(saved AS BIGINT) AS saved, domain, arg_max(event_type, event_id) AS brand_name, max(event_id) AS version, min(first_saved) AS first_saved
FROM v JOIN (SELECT *, min(event_id) OVER (PARTITION BY domain, batch) AS first_saved FROM e) ON batch <= saved GROUP BY ALL"""
)
def history_versions(t: Tables) -> DataFrame:
    """Records put in in three versions, the second one twice, and each version read back."""
    folder = new_path(t.spark, "history")
    rows = _records(t).select("domain", "brand_name", F.col("event_id").alias("version"))
    for number in (1, 2, 2, 3):
        history_store.put(rows.where(F.col("version") % 3 + 1 == number), folder, f"part-{number}")
    out = None
    for saved in (1, 2, 3):
        read = history_store.read_version(t.spark, folder, saved).select(
            F.lit(saved).cast("long").alias("saved"), "domain", "brand_name", "version", "first_saved"
        )
        out = read if out is None else out.unionByName(read)
    return out


@query(
    f"""
WITH {_RECORDS_SQL},
h AS (SELECT domain, CASE WHEN event_id % 3 = 0 THEN '' ELSE brand_name END AS brand_name,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE string_split(brand_name, 'i') END AS pool FROM records WHERE r = 1),
q AS (SELECT c_custkey AS request_id, 'u' || CAST(c_custkey * 2 AS VARCHAR) || '.example' AS domain, c_name AS brand_name FROM customer)
SELECT q.request_id, coalesce(nullif(h.brand_name, ''), q.brand_name) AS brand_name, h.domain IS NOT NULL AS matched,
  coalesce(len(h.pool), 0) AS n_pool
FROM q LEFT JOIN h USING (domain)"""
)
def history_fill(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    latest = hist.latest_records(_records(t))
    stored = latest.select(
        "domain",
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("brand_name")).alias("brand_name"),
        *[none.alias(c) for c in ("target_market", "competitor_urls", "brand_info")],
        F.when(F.col("event_id") % 4 != 0, F.split("brand_name", "i")).alias("keywords_pool"),
    )
    requests = t.customer.select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.lit("u"), (F.col("c_custkey") * 2).cast("string"), F.lit(".example")).alias("domain"),
        F.col("c_name").alias("brand_name"),
        *[none.alias(c) for c in ("target_market", "competitor_urls", "brand_info")],
    )
    return hist.fill_from_history(requests, stored).select(
        "request_id", "brand_name", "matched", kw.pool_size(F.col("keywords_pool")).alias("n_pool")
    )


# Pools of a thousand part names; half of all edits, one for each line item, are of
# the first pool. Deletions are of the first word, so that SQL can say where an edit meets.
_LOG_EDITS = """
  SELECT CAST(CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE floor(l_partkey / 1000) END AS BIGINT) AS domain,
    CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS edit_no,
    CASE WHEN l_partkey % 97 = 0 THEN 0 ELSE l_suppkey * 7 % 1100 END AS pos,
    CASE WHEN l_partkey % 97 = 0 THEN 'delete' ELSE 'set' END AS op,
    'w' || CAST(l_orderkey AS VARCHAR) AS value"""


@query(
    f"""
WITH word AS (
  SELECT CAST(floor(p_partkey / 1000) AS BIGINT) AS domain, p_name AS word,
    row_number() OVER (PARTITION BY floor(p_partkey / 1000) ORDER BY p_partkey) - 1 AS i FROM part
),
edit AS ({_LOG_EDITS} FROM lineitem),
met AS (
  SELECT *, row_number() OVER w AS nr, coalesce(sum(CAST(op = 'delete' AS INT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM edit WINDOW w AS (PARTITION BY domain ORDER BY edit_no, pos, op, value)
),
last AS (SELECT domain, pos + gone AS i, arg_max(value, nr) AS value FROM met WHERE op = 'set' GROUP BY ALL),
total AS (SELECT domain, sum(CAST(op = 'delete' AS INT)) AS gone FROM edit GROUP BY ALL)
SELECT word.domain, CAST(i - coalesce(gone, 0) AS BIGINT) AS place, coalesce(value, word) AS word
FROM word LEFT JOIN last USING (domain, i) LEFT JOIN total USING (domain) WHERE i >= coalesce(gone, 0)"""
)
def pool_edit_log(t: Tables) -> DataFrame:
    """A long log of edits, half of them of one pool, as scripts joined in a tree."""
    pools = t.part.groupBy(F.floor(F.col("p_partkey") / 1000).cast("string").alias("domain")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda p: p["p_name"]).alias("keywords_pool")
    )
    edits = t.lineitem.select(
        F.expr("CAST(CAST(CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE floor(l_partkey / 1000) END AS BIGINT) AS STRING)").alias("domain"),
        F.expr("CAST(l_orderkey * 8 + l_linenumber AS BIGINT)").alias("edit_no"),
        F.expr("CASE WHEN l_partkey % 97 = 0 THEN 0 ELSE l_suppkey * 7 % 1100 END").alias("pos"),
        F.expr("CASE WHEN l_partkey % 97 = 0 THEN 'delete' ELSE 'set' END").alias("op"),
        F.concat(F.lit("w"), F.col("l_orderkey").cast("string")).alias("value"),
    )
    return hist.edit_pools(pools, edits).select(
        F.col("domain").cast("bigint").alias("domain"), F.posexplode("keywords_pool").alias("place", "word")
    ).select("domain", F.col("place").cast("bigint").alias("place"), "word")


@query(
    f"""
WITH h AS (SELECT doc_id, {sql_parts('text', ',')} AS pool FROM documents),
e AS (SELECT doc_id, quality + 2 * toxic AS pos, quality = 1 AS is_set, 'kw ' || CAST(doc_id AS VARCHAR) AS value FROM labels),
one AS (SELECT h.doc_id, pos, CASE WHEN pos IS NULL OR pos >= len(pool) THEN pool
  WHEN is_set THEN list_concat(list_concat(pool[1:pos], [value]), pool[pos + 2:])
  ELSE list_concat(pool[1:pos], pool[pos + 2:]) END AS p FROM h LEFT JOIN e USING (doc_id)),
two AS (SELECT doc_id, pos, CASE WHEN pos IS NULL OR len(p) = 0 THEN p ELSE p[2:] END AS p FROM one),
three AS (SELECT doc_id, CASE WHEN pos IS NULL OR pos >= len(p) THEN p
  ELSE list_concat(list_concat(p[1:pos], ['again']), p[pos + 2:]) END AS p FROM two)
SELECT doc_id, array_to_string(p, '|') AS pool FROM three"""
)
def pool_edits(t: Tables) -> DataFrame:
    """Comma parts of each document as its pool; three edits for each label.

    The second edit moves the places, the third goes to the place of the first.
    """
    pools = t.documents.select(
        F.col("doc_id").cast("string").alias("domain"), tx.comma_list(F.col("text")).alias("keywords_pool")
    )
    pos = (F.col("quality") + 2 * F.col("toxic")).cast("int")
    none = F.lit(None).cast("string")

    def edit(number: int, pos: Column, op: Column, value: Column) -> Column:
        return F.struct(
            F.lit(number).alias("edit_no"), pos.alias("pos"), op.alias("op"), value.alias("value")
        )

    first = edit(
        1,
        pos,
        F.when(F.col("quality") == 1, "set").otherwise("delete"),
        F.concat(F.lit(" kw "), F.col("doc_id").cast("string"), F.lit(" ")),
    )
    others = (edit(2, F.lit(0), F.lit("delete"), none), edit(3, pos, F.lit("set"), F.lit(" again ")))
    edits = t.labels.select(
        F.col("doc_id").cast("string").alias("domain"), F.inline(F.array(first, *others))
    )
    return hist.edit_pools(pools, edits).select(
        F.col("domain").cast("long").alias("doc_id"), F.array_join("keywords_pool", "|").alias("pool")
    )


@query(
    """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS n_records,
  CASE WHEN event_id % 5 <> 0 THEN event_type END AS brand_name
FROM events"""
)
def history_parse(t: Tables) -> DataFrame:
    """Stored history texts, every fifth one damaged."""
    record = F.struct(F.lit("a.example").alias("domain"), F.col("event_type").alias("brand_name"))
    text = F.to_json(F.array(record, record))
    damaged = F.when(F.col("event_id") % 5 == 0, F.substring(text, 1, 30)).otherwise(text)
    parsed = t.events.select("event_id", hist.parse_history(damaged).alias("h"))
    return parsed.select(
        "event_id",
        F.size("h").alias("n_records"),
        F.try_element_at("h", F.lit(1)).brand_name.alias("brand_name"),
    )


@query(
    f"""
WITH {_RECORDS_SQL},
placed AS (SELECT domain, row_number() OVER (ORDER BY event_id DESC) - 1 AS pos FROM records WHERE r = 1)
SELECT domain FROM placed WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey * 2 = pos)"""
)
def history_delete_places(t: Tables) -> DataFrame:
    """Every other place of the list goes, as far as there are parts."""
    stored = hist.latest_records(_records(t)).withColumn("first_saved", F.col("event_id"))
    places = t.part.select((F.col("p_partkey") * 2).alias("pos"))
    return hist.delete_positions(stored, places).select("domain")


@query(
    f"""
WITH {_RECORDS_SQL} SELECT domain FROM records WHERE r = 1
  AND NOT EXISTS (SELECT 1 FROM customer WHERE 'u' || CAST(c_custkey * 3 AS VARCHAR) || '.example' = domain)"""
)
def history_delete(t: Tables) -> DataFrame:
    gone = t.customer.select(
        F.concat(F.lit("u"), (F.col("c_custkey") * 3).cast("string"), F.lit(".example")).alias("domain")
    )
    return hist.delete_records(hist.latest_records(_records(t)), gone).select("domain")
