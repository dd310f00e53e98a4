import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from copyloom.llm import exact_dedup
from tests.llm import odd_rows


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_filters_hold_their_keys(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    made = exact_dedup.build_filter(np.concatenate([keys, keys]))
    assert exact_dedup.in_filter(keys, *made).all()
    others = rng.integers(1 << 63, 1 << 64, 20_000, dtype=np.uint64)
    assert exact_dedup.in_filter(others, *made).mean() < 0.01
    if n > 1000:
        assert len(made[3]) < 1.4 * n


def plain(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, _ in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256((t or "").encode()).hexdigest()
        out.append((i, keep, len(ids), i == keep, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("earlier", ["doc_id < 5", "doc_id % 2 = 0", "false", "true"])
def test_against_plain(spark, earlier):
    got = exact_dedup.exact_dedup(odd_rows.docs(spark), F.expr(earlier)).collect()
    assert sorted(map(tuple, got), key=str) == plain(odd_rows.ROWS)


def test_equal_digests_of_unequal_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_digest", lambda: F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 1)))
    rows = [(i, f"text {i % 40}", "en") for i in range(90)]
    got = exact_dedup.exact_dedup(odd_rows.docs(spark, rows), F.expr("doc_id < 30")).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(r[:4] for r in plain(rows))


def test_empty(spark):
    assert exact_dedup.exact_dedup(odd_rows.empty(spark), F.expr("doc_id < 5")).collect() == []
