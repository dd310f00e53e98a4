import random
import re

import pytest

from copyloom.operators import terms
from copyloom.operators.quality import word_counts


def plain(rows, words):
    """Every place of a term, overlapping ones too, that touches no word sign."""
    out = {}
    for i, text in rows:
        for w in {w.lower() for w in words if w and re.search(r"\w", w)}:
            at = re.compile(rf"(?=(?<!\w){re.escape(w)}(?!\w))")
            n = len(at.findall((text or "").lower()))
            if n:
                out[(i, w)] = out.get((i, w), 0) + n
    return out


def found(spark, rows, words):
    texts = spark.createDataFrame(rows, "id int, text string")
    listed = spark.createDataFrame([(w,) for w in words], "term string")
    got = terms.term_uses(texts, listed)
    assert got.columns == ["id", "term", "n"]
    rows = got.collect()
    assert len({(r.id, r.term) for r in rows}) == len(rows)
    return {(r.id, r.term): r.n for r in rows}


CASES = [
    (1, "We ELEVATE and elevate; re-elevated, a delicate dance. Delicate  dance"),
    (2, "ha ha ha"),
    (3, "C++ and c++x, xC++ .NET net .net, in#1 #1"),
    (4, "élan Élan, élans"),
    (5, ""),
    (6, None),
    (7, " -- "),
    (1, "elevate"),
]
WORDS = [
    "Elevate", "elevate", "delicate dance", "ha ha", "c++", ".NET", "net", "#1", "élan", "--", "", None, "a delicate dance. delicate",
]


def test_by_hand(spark):
    got = found(spark, CASES, WORDS)
    assert got[(1, "elevate")] == 3 and got[(1, "delicate dance")] == 1 and got[(2, "ha ha")] == 2
    assert got[(3, "c++")] == 1 and got[(3, ".net")] == 2 and got[(3, "net")] == 3 and got[(4, "élan")] == 2
    assert got == plain(CASES, WORDS)


@pytest.mark.parametrize("most", [0, 500_000])
def test_against_plain(spark, monkeypatch, most):
    monkeypatch.setattr(terms, "BROADCAST_TERMS", most)
    rng = random.Random(4)
    signs, letters = [" ", " ", ", ", ".", "-", "  ", "\n", "+"], ["a", "b", "ab", "A", "é", "1"]
    made = lambda n: "".join(rng.choice(letters) + rng.choice(signs) for _ in range(n))
    rows = [(i, rng.choice(["", " ", "("]) + made(rng.randint(0, 60))) for i in range(60)]
    words = [rng.choice(["", "+", "-"]) + made(rng.randint(1, 4)).rstrip(" ") for _ in range(150)]
    got = found(spark, rows, words)
    assert got == plain(rows, words) and len(got) > 200


def test_like_the_short_list(spark):
    rows = [(i, t) for i, (_, t) in enumerate(CASES)]
    listed = ["elevate", "delicate dance", "net"]
    texts = spark.createDataFrame(rows, "id int, text string")
    want = {
        (r.id, w.word): w.n for r in texts.select("id", word_counts(texts.text, listed).alias("w")).collect() for w in r.w or []
    }
    assert found(spark, rows, listed) == want


def test_without_terms_or_texts(spark):
    assert found(spark, CASES, []) == {} and found(spark, CASES, ["--", None]) == {} and found(spark, [], WORDS) == {}


def test_the_list_does_not_multiply_the_texts(spark):
    texts = spark.createDataFrame([(i, "one two three four") for i in range(10)], "id int, text string")
    listed = spark.range(3000).selectExpr("concat('word', id) as term").union(spark.sql("select 'two three' as term"))
    plan = terms.term_uses(texts, listed)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert terms.term_uses(texts, listed).count() == 10
