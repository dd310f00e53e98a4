from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from copyloom.llm import language, queries
from copyloom.llm.tokens import coder
from copyloom.plans.workdir import new_path
from tests.llm import odd_rows, test_decontamination, test_near_dedup

FOLDER = Path("/root/testdata/sf0.001")


def kept_ids(rows, near, items):
    """Ids that plain versions of stages 2 to 4 leave."""
    last = {}
    for i, t, _ in rows:
        last[t or ""] = max(last.get(t or "", i), i)
    rows = [r for r in rows if last[r[1] or ""] == r[0]]
    head = {i: c for i, _, c in near(rows)}
    rows = [r for r in rows if head[r[0]] == r[0]]
    test_decontamination.ITEMS, old = items, test_decontamination.ITEMS
    try:
        bad = {r[0] for r in test_decontamination.plain(rows) if r[4]}
    finally:
        test_decontamination.ITEMS = old
    return [r for r in rows if r[0] not in bad]


def run_and_compare(spark, folder, rows, items):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    told = language.detected(docs, language.fit(docs)).where("lang_accepted").select("doc_id").collect()
    accepted = {r.doc_id for r in told}
    left = kept_ids([r for r in rows if r[0] in accepted], test_near_dedup.plain, items)
    got = corpus_pipeline.run(spark, str(folder)).collect()
    c = coder("word_bpe_49k.json", True)
    want = {}
    for i, t, _ in left:
        n = len(c.whole(t or "")) // 4 + 1
        for piece in range(-(-n // 4096)):
            want[i, piece] = min(4096, n - piece * 4096)
    assert {(r.doc_id, r.piece): r.length for r in got} == want and len(got) == len(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 4096
    return left


@pytest.mark.skipif(not FOLDER.exists(), reason="no driver tables")
def test_driver_tables(spark):
    con = duckdb.connect()
    rows = con.sql(f"SELECT doc_id, text, lang FROM '{FOLDER}/documents.parquet'").fetchall()
    items = con.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    left = run_and_compare(spark, FOLDER, rows, items)
    assert 0.5 * len(rows) < len(left) < len(rows)


def test_odd_tables(spark):
    folder = new_path(spark, "folder")
    rows = [r for r in odd_rows.ROWS if r[0] is not None][:-1]
    items = test_decontamination.ITEMS
    odd_rows.docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    run_and_compare(spark, folder, rows, items)


def test_stages_keep_the_columns(spark):
    folder = new_path(spark, "folder")
    odd_rows.empty(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(test_decontamination.ITEMS, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = odd_rows.docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert corpus_pipeline.run(spark, folder).collect() == []


@pytest.mark.skipif(not FOLDER.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_with_sql(spark, name):
    from tools.compare import TABLES, compare

    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    assert compare(spark, con, name, str(FOLDER)).startswith("ok")


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_rows_without_an_id_and_shared_ids(spark):
    folder = new_path(spark, "folder")
    words = lambda n, k=60: " ".join(f"p{n}w{i}" for i in range(k))
    bad = "Here it is: " + words("bench", 12)
    spark.createDataFrame([(1, words("bench", 12))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [
        *[r for r in odd_rows.ROWS],
        (None, odd_rows.ROWS[0][1], "en"), (None, words(1), "en"), (None, words(1), "en"), (None, words(2), "en"), (None, bad, "en"),
        (20, words(3), "en"), (20, words(4), "en"), (21, words(4), "en"), (20, bad, "en"),
        (30, words(5), "en"), (31, words(5) + " more", "en"), (31, words(6), "en"),
    ]
    docs = odd_rows.docs(spark, rows)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, folder)
    twice, empty = odd_rows.ROWS[0][1], (4, "")
    gone = [(1, twice), (None, twice), (3, None), (None, bad), (20, bad), (20, words(4)), (31, words(5) + " more")]
    want = {(i, t) for i, t, _ in rows} - set(gone)
    got = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and empty in want
