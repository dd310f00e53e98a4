"""Columns with names that operators use inside, and a map column, come back as they were."""

from pyspark.sql import functions as F

from copyloom.llm import decontamination, line_dedup, sharding
from tests.llm import odd_rows

NAMES = ["_kept", "_spans", "_gone_id", "_gone_row", "_bad_id", "_bad_row", "_slot", "_id", "_sha", "_same", "_row"]


def given(spark):
    lines = "first line of it\nand the second line"
    rows = [(1, f"a\n{lines}", "en"), (2, f"b\n{lines}", "en"), (None, None, None), (3, "x " + BENCH, "en")]
    docs = odd_rows.docs(spark, rows).withColumns({n: F.lit(f"my{n}") for n in NAMES})
    return docs.withColumn("pairs", F.create_map(F.lit("k"), F.lit(1)))


BENCH = " ".join(f"bench{i}" for i in range(12))


def same(got, docs, rows):
    assert got.columns[: len(docs.columns)] == docs.columns
    found = got.collect()
    assert len(found) == rows
    assert all(r[n] == f"my{n}" for r in found for n in NAMES) and all(r.pairs == {"k": 1} for r in found)
    return found


def test_operators(spark):
    docs = given(spark)
    items = spark.createDataFrame([(1, BENCH)], "item_id bigint, text string")
    passages = {r.doc_id: r.text for r in same(line_dedup.passage_dedup(docs), docs, 4)}
    assert passages[2] == "b"
    same(sharding.placed(docs, "doc_id", ["s1", "s2"], 101), docs, 4)
    same(decontamination.decontaminated(docs, items), docs, 3)
    cut = {r.doc_id: r.text for r in same(decontamination.decontaminated(docs, items, spans=True), docs, 4)}
    assert cut[3].strip() == "x"


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = given(spark)
    same(corpus_pipeline.without_copies(spark, docs.unionByName(docs.limit(1)), ""), docs, 4)
