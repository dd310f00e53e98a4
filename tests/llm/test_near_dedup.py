import random
import re

import pyarrow as pa
import pytest

from copyloom.llm import graph, near_dedup, shingles
from tests.llm import odd_rows


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = word_list(text)
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def plain(rows):
    sets = [(i, shingle_set(t)) for i, t, _ in rows]
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i, _ in sets if i is not None]
    for i in ids:
        root[i] = i
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def near_copies(seed, groups, size, words=60):
    rng = random.Random(seed)
    rows, i = [], 1000 * seed
    common = [f"common{k}" for k in range(12)]
    for g in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(words)] + common
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(words)] = f"n{rng.random()}"
            if rng.random() < 0.3:
                copy[0] = copy[0].upper()
            rows.append((i, rng.choice([" ", "\n"]).join(copy), "en"))
            i += 1
    rng.shuffle(rows)
    return rows


def test_shingles_are_those_of_the_words():
    rng = random.Random(4)
    signs = ["a", "A", "b c", " ", "\t", "\n", "é", "É", "　", "\x0b", "word", "\x85", "x"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, "", odd_rows.LONG]
    seen = {}
    for text, hashes in zip(texts, shingles.shingle_hashes(pa.array(texts), 5)):
        w = word_list(text)
        want = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        assert len(hashes) == len(want)
        for h, s in zip(hashes.tolist(), want):
            assert seen.setdefault(h, s) == s
    assert len(set(seen.values())) == len(seen)


def test_against_plain(spark):
    rows = [*odd_rows.ROWS, *near_copies(1, 8, 6), *near_copies(2, 1, 40)]
    got = near_dedup.near_dedup(odd_rows.docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_neighbours_across_partitions(spark, monkeypatch):
    rows = near_copies(3, 12, 3)
    docs = odd_rows.docs(spark, rows)
    repartition = type(docs).repartitionByRange
    monkeypatch.setattr(type(docs), "repartitionByRange", lambda self, n, *c: repartition(self, 7, *c))
    got = near_dedup.near_dedup(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(rows)


def test_empty(spark):
    assert near_dedup.near_dedup(odd_rows.empty(spark)).collect() == []


@pytest.mark.parametrize("links", ["chain", "random", "star"])
def test_components(spark, links):
    rng = random.Random(5)
    pairs = {
        "chain": [(i, i + 1) for i in range(60)],
        "random": [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(None, 3)],
        "star": [(50, i) for i in range(60)],
    }[links]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in list(root))


@pytest.mark.parametrize("block", [2048, 250])
def test_pairs_in_a_dense_source_of_unlike_pages(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    template = [f"t{k}" for k in range(94)]  # 90 shingles; pages share 0.72 of their union, pairs 0.765
    rows = []
    for i in range(800):
        tail = [f"u{i}x{k}" for k in range(17 if i % 2 else 18)]
        if i < 160:
            tail[:4] = [f"pair{i // 2}x{k}" for k in range(4)]
        rows.append((i, " ".join(template + tail), "en"))
    for i in range(0, 160, 2):
        a, b = shingle_set(rows[i][1]), shingle_set(rows[i + 1][1])
        assert 100 * len(a & b) >= 75 * len(a | b)
    assert 100 * 90 < 75 * (90 + 17 + 17)
    random.Random(1).shuffle(rows)
    given = []
    region_links = near_dedup.region_links
    monkeypatch.setattr(near_dedup, "region_links", lambda *a: given.append(region_links(*a)) or given[0])
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(odd_rows.docs(spark, rows)).collect()}
    # Some 300,000 pairs that are nearly alike stay where they are compared.
    assert all(a // 2 == b // 2 for a, b in given[0].collect())
    assert got == {i: i - i % 2 if i < 160 else i for i in range(800)}


def test_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(near_dedup, "NEAR", ((1, 8),))  # leaves nearly all to the second search
    rows = near_copies(4, 2, 50)
    got = near_dedup.near_dedup(odd_rows.docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(rows)


def test_small_groups_are_compared_without_frames(spark, monkeypatch, capfd):
    monkeypatch.setattr(near_dedup, "NEAR", ((1, 8),))
    plans = []
    region_links = near_dedup.region_links
    monkeypatch.setattr(near_dedup, "region_links", lambda *a: plans.append(region_links(*a)) or plans[0])
    rows = near_copies(5, 20, 2)
    got = near_dedup.near_dedup(odd_rows.docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(rows)
    plans[0].explain()
    plan = capfd.readouterr().out or plans[0]._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "FlatMapGroupsInPandas" not in plan
