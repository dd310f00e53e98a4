"""Keywords, lists, escapes, answers and sections over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom import rules
from copyloom.catalog import Tables, query, sql_parts, sql_strip
from copyloom.functions import answers
from copyloom.functions import keywords as kw
from copyloom.functions import text as tx
from copyloom.operators import generation
from copyloom.plans.flows import write_new
from copyloom.plans.skew import concat_in_order
from copyloom.plans.workdir import new_path
from copyloom.streaming import reassembly

_COMMAS = sql_parts("text", ",")
_BOTH = sql_parts("text", "[,\\n]")
_LINES = sql_parts("text", "\\n")


@query(
    f"""
WITH k AS (SELECT conv_id, turn, {_COMMAS} AS c, {_BOTH} AS b, {_LINES} AS l FROM conversations)
SELECT conv_id, turn, array_to_string(c, '|') AS commas, array_to_string(b, '|') AS commas_or_lines,
  array_to_string(l, '|') AS lines, len(c) AS n_keywords,
  CASE WHEN len(c) < 5 THEN 'under 5' WHEN len(c) > 10 THEN 'over 10' ELSE '5-10' END AS band
FROM k"""
)
def keyword_parse(t: Tables) -> DataFrame:
    typed = F.col("text")
    count = kw.keyword_count(typed)
    return t.conversations.select(
        "conv_id", "turn",
        F.array_join(tx.comma_list(typed), "|").alias("commas"),
        F.array_join(tx.comma_or_line_list(typed), "|").alias("commas_or_lines"),
        F.array_join(tx.line_list(typed), "|").alias("lines"),
        count.alias("n_keywords"),
        kw.keyword_band(count).alias("band"),
    )


# Words of a turn as the pool, a second cut of the same turn as what is typed.
_POOL = "string_split(text, ' ')"
_TYPED = "replace(lower(text), ' ', ',')"


@query(
    f"""
WITH k AS (
  SELECT conv_id, turn, list_filter(list_transform({_POOL}, lambda v: {sql_strip('v')}), lambda v: v <> '') AS pool,
    {sql_parts(_TYPED, "[,\\n]")} AS typed
  FROM conversations
),
u AS (SELECT *, list_concat(pool, typed) AS u2, list_filter(typed, lambda v: NOT list_contains(pool, v)) AS fresh FROM k)
SELECT conv_id, turn, array_to_string(list_filter(u2, lambda v, i: list_position(u2, v) = i), '|') AS merged,
  array_to_string(list_concat(pool, fresh), '|') AS added, len(fresh) AS n_new, len(pool) AS n_pool
FROM u"""
)
def keyword_merge(t: Tables) -> DataFrame:
    typed = F.expr(_TYPED)
    base = t.conversations.select(
        "conv_id", "turn",
        tx.non_blank(F.split("text", " ")).alias("pool"),
        typed.alias("typed"),
    )
    pool, text = F.col("pool"), F.col("typed")
    return base.select(
        "conv_id", "turn",
        F.array_join(kw.merge(pool, tx.comma_or_line_list(text)), "|").alias("merged"),
        F.array_join(kw.add_typed(pool, text), "|").alias("added"),
        F.size(kw.new_keywords(pool, text)).cast("long").alias("n_new"),
        kw.pool_size(pool).alias("n_pool"),
    )


@query(
    f"""
WITH k AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN [] ELSE {_COMMAS} END AS c FROM conversations),
n AS (SELECT conv_id, turn, c, list_transform(c, lambda v, i: CAST(i AS VARCHAR) || '. ' || v || chr(10)) AS r FROM k)
SELECT conv_id, turn, array_to_string(r, '') AS numbered,
  CASE WHEN len(c) > 0 THEN array_to_string(c, ', ') ELSE '{rules.NOT_GIVEN}' END AS joined FROM n"""
)
def numbered_list(t: Tables) -> DataFrame:
    items = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(
        tx.comma_list(F.col("text"))
    )
    listed = t.conversations.select("conv_id", "turn", items.alias("c"))
    return listed.select(
        "conv_id", "turn",
        tx.numbered_lines(F.col("c")).alias("numbered"),
        tx.joined_or(F.col("c"), rules.NOT_GIVEN).alias("joined"),
    )


_LANGUAGE = "CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE lang END"


@query(
    f"""
SELECT doc_id, CASE {_LANGUAGE} WHEN 'English' THEN '🇺🇸' WHEN 'French' THEN '🇫🇷' WHEN 'German' THEN '🇩🇪' ELSE '🌐' END AS flag
FROM documents"""
)
def lang_flag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.language_flag(F.expr(_LANGUAGE)).alias("flag"))


@query(
    """
SELECT doc_id,
  replace(replace(replace(replace(text || '<a b="c">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html,
  replace(replace(text || '''q''"r"', '"', '&quot;'), '''', '&#39;') AS attr
FROM documents"""
)
def escape_html(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        tx.escape_html(F.concat(text, F.lit('<a b="c">'))).alias("html"),
        tx.escape_attr(F.concat(text, F.lit("'q'\"r\""))).alias("attr"),
    )


# Bold openers become headings, so that every block rule has something to do.
_RENDERED = "replace(replace(html, '<b>', '<h2>'), '<br>', '</h2><h3>')"


def _snippet_sql() -> str:
    out = "regexp_replace(h, '(?i)<h1[^>]*>.*?</h1>', '', 'g')"
    for tag in ("h2", "h3"):
        out = f"replace({out}, '<{tag}>', chr(10) || '<{tag}>')"
    for tag in ("h2", "h3", "p", "ul", "ol"):
        out = f"replace({out}, '</{tag}>', '</{tag}>' || chr(10))"
    return sql_strip(f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"SELECT page_id, {_snippet_sql()} AS snippet FROM (SELECT page_id, {_RENDERED} AS h FROM pages)")
def snippet_cleanup(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.tidy_snippet(F.expr(_RENDERED)).alias("snippet"))


# -- generated answers --------------------------------------------------------

def _answer(text: Column) -> Column:
    part = F.struct(F.array(F.struct(text.alias("text"))).alias("parts"))
    return F.to_json(F.struct(F.array(F.struct(part.alias("content"))).alias("candidates")))


def _stream_lines(t: Tables) -> DataFrame:
    """Each turn as a chunk line, among lines that carry nothing."""
    line = F.concat(F.lit(rules.LINE_PREFIX), _answer(F.col("text")))
    lines = F.array(F.lit(": note"), line, F.lit("data: {bad"), F.lit("data: [DONE]"), F.lit(""))
    return t.conversations.select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.explode(lines).alias("line")
    )


_TEXTS = """
WITH once AS (SELECT conv_id AS request_id, turn, min(text) AS text FROM conversations GROUP BY ALL)
SELECT request_id, count(*) AS n_chunks, string_agg(text, '' ORDER BY turn) AS text FROM once GROUP BY request_id"""


@query(_TEXTS)
def chunk_reassembly(t: Tables) -> DataFrame:
    return generation.reassemble(generation.decode_lines(_stream_lines(t)))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS text FROM conversations")
def answer_text(t: Tables) -> DataFrame:
    body = F.when(F.col("turn") % 4 == 3, F.lit('{"candidates": []}')).otherwise(_answer(F.col("text")))
    return t.conversations.select("conv_id", "turn", answers.answer_text(body).alias("text"))


@query(
    """
WITH once AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL),
whole AS (SELECT conv_id AS request_id, string_split(string_agg(text, '' ORDER BY turn), chr(10)) AS l FROM once GROUP BY conv_id)
SELECT request_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS seq, unnest(l) AS line FROM whole"""
)
def fragment_lines(t: Tables) -> DataFrame:
    """Turns as raw arrivals that are cut anywhere; lines come out whole."""
    fragments = t.conversations.groupBy(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("seq")
    ).agg(F.min("text").alias("fragment"))
    return generation.join_fragments(fragments)


# Ends per conversation: done behind the last turn, an error at turn 2, or none.
def _relay_events(t: Tables) -> DataFrame:
    chunk = t.conversations.select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.lit("chunk").alias("type"),
        "text", F.lit(None).cast("string").alias("message"),
    )
    last = t.conversations.groupBy(F.col("conv_id").alias("request_id")).agg(F.max("turn").alias("_last"))
    kind = F.col("request_id") % 3
    ends = last.where(kind != 2).select(
        "request_id",
        F.when(kind == 0, F.col("_last") + 1).otherwise(F.lit(2)).cast("long").alias("seq"),
        F.when(kind == 0, "done").otherwise("error").alias("type"),
        F.lit(None).cast("string").alias("text"),
        F.when(kind == 1, "broken off").alias("message"),
    )
    return chunk.unionByName(ends)


_CLOSED = """
WITH once AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL),
kept AS (SELECT * FROM once WHERE conv_id % 3 <> 1 OR turn < 2),
texts AS (SELECT conv_id, count(*) AS n, string_agg(text, '' ORDER BY turn) AS text FROM kept GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id AS request_id, coalesce(n, 0) AS n_chunks, coalesce(text, '') AS text,
  ['done', 'error', 'open'][1 + conv_id % 3] AS status,
  CASE WHEN conv_id % 3 = 1 THEN 'broken off' END AS message
FROM ids LEFT JOIN texts USING (conv_id)"""


@query(_CLOSED)
def close_generations(t: Tables) -> DataFrame:
    return generation.close_generations(_relay_events(t))


@query(_CLOSED)
def relay_lines(t: Tables) -> DataFrame:
    """Relay events as lines, among lines that carry none, decoded and closed."""
    lines = generation.encode_relay(_relay_events(t)).withColumn(
        "line",
        F.explode(
            F.concat(
                F.split("line", "\n"),
                F.array(F.lit("data: {bad"), F.lit('data: {"type":"ping"}'), F.lit(": note")),
            )
        ),
    )
    return generation.close_generations(generation.decode_relay(lines))


@query(_TEXTS)
def stream_reassembly(t: Tables) -> DataFrame:
    """Live text of a file stream, taken when all input has arrived."""
    # As a pattern, the path may be a file or a folder of files.
    path = f"{t.folder}/conversations.parque[t]"
    chunks = t.spark.readStream.schema(t.conversations.schema).parquet(path)
    named = chunks.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), "text")
    with reassembly.rocksdb(t.spark):
        return reassembly.run_to_table(reassembly.live_text(named, None), "live-text", mode="update")


@query(
    """
WITH once AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE conv_id % 3 <> 2 GROUP BY ALL),
kept AS (SELECT * FROM once WHERE conv_id % 3 <> 1 OR turn < 2),
texts AS (SELECT conv_id, count(*) AS n, string_agg(text, '' ORDER BY turn) AS text FROM kept GROUP BY conv_id),
ids AS (SELECT conv_id, max(turn) + 1 = count(DISTINCT turn) AS whole, count(DISTINCT turn) FILTER (turn < 2) = 2 AS two
  FROM conversations WHERE conv_id % 3 <> 2 GROUP BY conv_id)
SELECT conv_id AS request_id, coalesce(n, 0) AS n_chunks, coalesce(text, '') AS text,
  ['done', 'error'][1 + conv_id % 3] AS status,
  CASE WHEN conv_id % 3 = 1 THEN 'broken off' END AS message
FROM ids LEFT JOIN texts USING (conv_id) WHERE CASE conv_id % 3 WHEN 1 THEN two ELSE whole END"""
)
def stream_generations(t: Tables) -> DataFrame:
    """Finished generations of a stream of relay events, in several batches and out of order.

    Those without an end, or with a gap before it, stay in state.
    """
    events = _relay_events(t)
    dealt = events.repartition(4, F.xxhash64("request_id", "seq", "type"))
    stream = (
        t.spark.readStream.schema(events.schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(write_new(dealt, "relay-events"))
    )
    with reassembly.rocksdb(t.spark):
        done = reassembly.assemble(stream, timeout_ms=None, closed_ttl_ms=None)
        return reassembly.run_to_table(done, "generations")


_CUTS = 7


@query(
    """
WITH x AS (SELECT conv_id, turn, unnest(string_split(text || chr(10) || 'end', chr(10))) AS line,
  generate_subscripts(string_split(text || chr(10) || 'end', chr(10)), 1) AS n FROM
  (SELECT conv_id, turn, any_value(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL))
SELECT conv_id * 1000 + turn AS request_id, n - 1 AS seq, line FROM x"""
)
def stream_lines(t: Tables) -> DataFrame:
    """Each turn cut into fragments that arrive out of order over several batches, framed into lines."""
    once = t.conversations.where("text is not null").groupBy("conv_id", "turn").agg(F.any_value("text").alias("text"))
    whole = F.concat("text", F.lit("\nend"))
    size = F.greatest(F.lit(1), F.ceil(F.length(whole) / _CUTS)).cast("int")
    cut = once.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        whole.alias("whole"),
        size.alias("size"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_CUTS - 1).cast("long"))).alias("seq"),
    )
    fragments = cut.select(
        "request_id",
        "seq",
        F.substring("whole", (F.col("seq") * F.col("size") + 1).cast("int"), F.col("size")).alias("fragment"),
        (F.col("seq") == _CUTS - 1).alias("last"),
    )
    dealt = fragments.repartition(3, F.xxhash64("request_id", "seq"))
    stream = (
        t.spark.readStream.schema(fragments.schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(write_new(dealt, "fragments"))
    )
    with reassembly.rocksdb(t.spark):
        return reassembly.run_to_table(reassembly.frame_lines(stream, None), "lines")


@query(
    """
WITH first AS (SELECT user_id, min(ts) AS begun, count(DISTINCT event_id) AS n FROM events GROUP BY user_id),
last AS (SELECT max(ts) AS now FROM events)
SELECT user_id AS request_id, n AS n_chunks,
  CASE WHEN epoch_ms(now) - epoch_ms(begun) >= 86400000 THEN 'timeout' ELSE 'open' END AS status
FROM first, last"""
)
def generations_timed_out(t: Tables) -> DataFrame:
    """Events of users as chunks that never end, closed by the clock of the last event."""
    last = t.events.agg(F.max("ts")).first()[0]
    events = t.events.select(
        F.col("user_id").alias("request_id"),
        F.col("event_id").alias("seq"),
        F.lit("chunk").alias("type"),
        F.col("event_type").alias("text"),
        F.lit(None).cast("string").alias("message"),
        F.col("ts").alias("at"),
    )
    closed = generation.close_generations(events, F.lit(last), timeout_ms=86_400_000)
    return closed.select("request_id", "n_chunks", "status")


@query(
    """
WITH x AS (SELECT conv_id, turn, unnest(string_split(text || chr(10) || 'é', chr(10))) AS line,
  generate_subscripts(string_split(text || chr(10) || 'é', chr(10)), 1) AS n FROM
  (SELECT conv_id, turn, replace(any_value(text), ' ', 'ü😀') AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL))
SELECT conv_id * 1000 + turn AS request_id, n - 1 AS seq, line FROM x"""
)
def stream_bytes(t: Tables) -> DataFrame:
    """Each turn, with many letters of two and four bytes, cut into fragments of bytes, framed into lines."""
    once = t.conversations.where("text is not null").groupBy("conv_id", "turn").agg(F.any_value("text").alias("text"))
    text = F.concat(F.replace("text", F.lit(" "), F.lit("ü😀")), F.lit("\né"))
    # Every other turn ends its lines with a carriage return and a newline.
    whole = F.when(F.col("turn") % 2 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    cut = once.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.encode(whole, "utf-8").alias("whole"))
    size = F.ceil(F.octet_length("whole") / _CUTS).cast("int")
    fragments = cut.select(
        "request_id", size.alias("size"), "whole", F.explode(F.sequence(F.lit(0), F.lit(_CUTS - 1))).alias("seq")
    ).select(
        "request_id",
        F.col("seq").cast("long").alias("seq"),
        F.substring("whole", (F.col("seq") * F.col("size") + 1).cast("int"), F.col("size")).alias("fragment"),
        (F.col("seq") == _CUTS - 1).alias("last"),
    )
    dealt = fragments.repartition(3, F.xxhash64("request_id", "seq"))
    stream = (
        t.spark.readStream.schema(fragments.schema).option("maxFilesPerTrigger", 1).parquet(write_new(dealt, "byte-fragments"))
    )
    with reassembly.rocksdb(t.spark):
        return reassembly.run_to_table(reassembly.frame_bytes(stream, None), "lines")


_DAY = 86_400_000


@query(
    f"""
WITH first AS (SELECT user_id, min(epoch_ms(ts)) AS begun FROM events GROUP BY user_id),
last AS (SELECT max(epoch_ms(ts)) AS now FROM events)
SELECT user_id AS request_id, count(DISTINCT event_id) AS n_chunks,
  string_agg(event_type, '' ORDER BY event_id) AS text, 'timeout' AS status
FROM events JOIN first USING (user_id), last
WHERE epoch_ms(ts) < begun + {_DAY} AND begun + {_DAY} <= now GROUP BY user_id"""
)
def stream_timeouts(t: Tables) -> DataFrame:
    """Events of users as chunks that never end, closed by the times in the stream, a quarter of the time a batch.

    The stream is stopped after its first batches and started again from its checkpoint.
    """
    events = t.events.select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"), F.col("ts").cast("timestamp").alias("at")
    )
    path = write_new(events.repartitionByRange(4, "at"), "dated-events")
    in_order = [r["f"] for r in t.spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("at").alias("a")).orderBy("a").collect()]
    arriving, done = new_path(t.spark, "arriving"), new_path(t.spark, "timed-out")
    progress = new_path(t.spark, "timed-out-progress")
    for number, file in enumerate(in_order):  # four files, of four ranges
        t.spark.read.schema(events.schema).parquet(file).coalesce(1).write.mode("append").parquet(arriving)
        if number % 2 == 0 and number + 1 < len(in_order):
            continue
        stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
        with reassembly.rocksdb(t.spark):
            over = reassembly.timed_out(stream, _DAY)
            over.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).format("parquet").option(
                "path", done
            ).start().awaitTermination()
    return t.spark.read.schema(over.schema).parquet(done).select("request_id", "n_chunks", "text", "status")


@query(
    """
WITH once AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations GROUP BY ALL),
prefix AS (SELECT * FROM once QUALIFY turn = row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)
SELECT conv_id AS request_id, count(*) AS n_chunks, string_agg(text, '' ORDER BY turn) AS text FROM prefix GROUP BY conv_id"""
)
def stream_deltas(t: Tables) -> DataFrame:
    """What each batch adds to the texts of a stream that arrives out of order, put together again."""
    chunks = t.conversations.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), "text")
    dealt = chunks.repartition(3, F.xxhash64("request_id", "seq"))
    stream = (
        t.spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(write_new(dealt, "chunks"))
    )
    with reassembly.rocksdb(t.spark):
        added = reassembly.run_to_table(reassembly.text_deltas(stream, None), "deltas")
    whole = concat_in_order(added.select("request_id", "seq", F.col("added").alias("text")), ["request_id"], "seq", "text")
    counts = added.groupBy("request_id").agg(F.sum("n_chunks").alias("n_chunks"))
    return whole.drop("n").join(counts, "request_id").select("request_id", "n_chunks", "text")


# -- sections -------------------------------------------------------------------

# The four shapes a text can have: both headings with sources, both with a
# checklist, only the first, none.
_SHAPED = """CASE doc_id % 4
  WHEN 0 THEN 'intro' || chr(10) || '## 📝 Collection Page Copy — X' || chr(10) || text || chr(10) || '##📝  中文对照版' || chr(10) || text || chr(10) || '## 📚 list'
  WHEN 1 THEN '## 📝 COLLECTION page copy' || chr(10) || text || chr(10) || '## 📝 中文对照版' || chr(10) || lang || chr(10) || '## ✅ done'
  WHEN 2 THEN '##  📝 Collection Page Copy' || chr(10) || text || chr(10) || '## 📚 list'
  ELSE text END"""


@query(
    f"""
SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN {sql_strip("'## 📝 Collection Page Copy — X' || chr(10) || text")}
    WHEN 1 THEN {sql_strip("'## 📝 COLLECTION page copy' || chr(10) || text")}
    WHEN 2 THEN '##  📝 Collection Page Copy' || chr(10) || text || chr(10) || '## 📚 list'
    ELSE text END AS page_copy,
  CASE doc_id % 4
    WHEN 0 THEN {sql_strip("'##📝  中文对照版' || chr(10) || text")}
    WHEN 1 THEN '## 📝 中文对照版' || chr(10) || lang ELSE '' END AS chinese_copy
FROM documents"""
)
def section_split(t: Tables) -> DataFrame:
    shaped = t.documents.select("doc_id", F.expr(_SHAPED.replace("chr(10)", "'\\n'")).alias("text"))
    return shaped.select(
        "doc_id",
        answers.page_section(F.col("text")).alias("page_copy"),
        answers.chinese_section(F.col("text")).alias("chinese_copy"),
    )


@query(
    f"""
WITH p AS (SELECT doc_id, strpos(lower(text), 'the') AS a, text FROM documents),
q AS (SELECT doc_id, CASE WHEN a > 0 THEN substr(text, a) END AS rest FROM p),
r AS (SELECT doc_id, rest, strpos(substr(rest, 4), '.') AS e FROM q)
SELECT doc_id, nullif({sql_strip("CASE WHEN e > 0 THEN substr(rest, 1, e + 2) ELSE rest END")}, '') AS part FROM r"""
)
def section_by_markers(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", answers.between_markers(F.col("text"), "the", ".").alias("part")
    )
