import re

import pytest

from copyloom.llm import decontamination
from tests.llm import odd_rows

ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(7, ITEM), (10, "Short item here"), (9, None), (12, "?!"), (None, "no id for this"), (11, "short ITEM here")]
TEXTS = [
    (100, f"Before it. {ITEM.upper()} and behind; short item here", "en"),
    (101, "alpha-beta,gamma delta epsilon zeta eta theta iota kappa", "en"),
    (102, "alpha beta gamma delta epsilon zeta eta theta iota nothing", "en"),
    (103, "Short, item: here? short item here no id for this", "en"),
    (104, "ÉTÉ short item here", "en"),
    (105, "shortitem here", "en"),
    (104, "ÉTÉ short item here", "en"),
]


def word_list(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(rows):
    windows = {}
    for item, text in ITEMS:
        w = word_list(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for i, t, _ in rows:
        w, hit, items = word_list(t), set(), set()
        for window, of in windows.items():
            n = len(window)
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) == window:
                    hit |= set(range(at, at + n))
                    items |= of - {None}
        out.append((i, len(w), len(hit), sorted(items), bool(hit), sorted(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [500_000, 3])
def test_against_plain(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    rows = [*odd_rows.ROWS, *TEXTS]
    benchmark = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id bigint, text string, words string")
    got = decontamination.contamination(odd_rows.docs(spark, rows), benchmark).collect()
    flat = [
        (r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated,
         sorted(i for s in r.spans for i in range(s.first, s.last + 1)))
        for r in got
    ]
    assert sorted(flat, key=str) == plain(rows)


def test_what_is_removed(spark):
    rows = [*odd_rows.ROWS, *TEXTS]
    docs = odd_rows.docs(spark, rows)
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    left = decontamination.decontaminated(docs, benchmark)
    assert left.columns == docs.columns
    bad = {r[0] for r in plain(rows) if r[4]}
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((r[0] for r in rows if r[0] not in bad), key=str)
    cut = {r.doc_id: r.text for r in decontamination.decontaminated(docs, benchmark, spans=True).collect()}
    assert cut[100] == "Before it.  and behind; "
    assert cut[104] == "ÉTÉ "
    assert cut[7] == odd_rows.ROWS[6][1] and cut[3] is None


def test_empty(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontamination.contamination(odd_rows.empty(spark), benchmark).collect() == []
    got = decontamination.contamination(odd_rows.docs(spark), benchmark.limit(0)).collect()
    assert len(got) == len(odd_rows.ROWS) and not any(r.contaminated for r in got)
