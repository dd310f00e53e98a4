import random
import re
import struct
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from copyloom.llm import line_dedup
from tests.llm import odd_rows


def hashed(parts):
    """Spark's xxhash64 of an array: each element's hash is the seed of the next."""
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else struct.pack("<q", p)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def cut(text):
    lines = text.split("\n") if text else []
    hashes = [hashed([x]) for x in lines]
    chunks, start = [], 0
    for i in range(len(lines)):
        ends = i >= 1 and hashed(hashes[i - 1 : i + 1]) % 2 == 0
        if ends or i == len(lines) - 1:
            chunks.append(lines[start : i + 1])
            start = i + 1
    return chunks


def plain(rows):
    places = defaultdict(set)
    count = defaultdict(int)
    for i, t, _ in rows:
        for n, chunk in enumerate(cut(t)):
            if len(chunk) >= 2:
                places[tuple(chunk)].add((i is None, i or 0, hashed([t]), n))
                count[tuple(chunk)] += 1
    out = []
    for i, t, _ in rows:
        chunks = cut(t)
        gone = [
            n
            for n, c in enumerate(chunks)
            if len(c) >= 2 and count[tuple(c)] > 1 and (i is None, i or 0, hashed([t]), n) != min(places[tuple(c)])
        ]
        left = "\n".join(x for n, c in enumerate(chunks) if n not in gone for x in c)
        out.append((i, left if gone else t, sum(map(len, chunks)), sum(len(chunks[n]) for n in gone), gone))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    shared = ["\n".join(f"shared {p} line {k}" for k in range(9)) for p in range(4)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append("\n".join(f"own {rng.random()}" for _ in range(rng.randint(0, 6))))
            if rng.random() < 0.6:
                parts.append(rng.choice(shared))
        rows.append((1000 + i, "\n".join(parts), "en"))
    return rows


def test_against_plain(spark):
    rows = [*odd_rows.ROWS, *passages(1)]
    docs = odd_rows.docs(spark, rows)
    got = line_dedup.line_dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed", "removed"]
    flat = [(r.doc_id, r.text, r.n_lines, r.n_removed, list(r.removed)) for r in got.collect()]
    assert sorted(flat, key=str) == plain(rows)
    assert sum(r[3] for r in flat) > 50


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    rows = passages(2)
    flat = [(r.doc_id, r.text, r.n_lines, r.n_removed, list(r.removed)) for r in line_dedup.line_dedup(odd_rows.docs(spark, rows)).collect()]
    assert sorted(flat, key=str) == plain(rows)


def test_different_chunks_of_one_hash(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_hash", lambda: F.pmod(F.xxhash64("body"), F.lit(9)))
    rows = passages(3)
    flat = [(r.doc_id, r.text, r.n_lines, r.n_removed, list(r.removed)) for r in line_dedup.line_dedup(odd_rows.docs(spark, rows)).collect()]
    assert sorted(flat, key=str) == plain(rows)


def test_empty(spark):
    assert line_dedup.line_dedup(odd_rows.empty(spark)).collect() == []


def sentence(rng, n):
    return " ".join([f"W{rng.random()}", *(f"w{rng.randint(0, 10**6)}" for _ in range(n - 1))]) + "."


def planted(seed, each=6):
    """Documents with passages of 1 to 9 lines and over 50 words, and the passages with where they come again."""
    rng = random.Random(seed)
    rows, plants, i = [], [], 1
    for n_lines in range(1, 10):
        for k in range(each):
            per_line = -(-60 // n_lines)
            # One line: half of them without any end of a sentence inside.
            passage = "\n".join(
                sentence(rng, per_line) if per_line < 60 or k % 2 else " ".join(sentence(rng, 15) for _ in range(4))
                for _ in range(n_lines)
            )
            for copy in range(3):
                own = lambda: [sentence(rng, rng.randint(1, 9)) for _ in range(rng.randint(0, 4))]  # noqa: B023, E731
                before, behind = own(), own()
                rows.append((i, "\n".join([*before, passage, *behind]), "en"))
                plants.append((i, n_lines, copy, passage, "\n".join([*before, *behind])))
                i += 1
    return rows, plants


def test_planted_passages_go_whole_at_every_length(spark):
    rows, plants = planted(7)
    got = {r.doc_id: r for r in line_dedup.passage_dedup(odd_rows.docs(spark, rows)).collect()}
    text = {i: t for i, t, _ in rows}
    went = defaultdict(list)
    for i, n_lines, copy, passage, rest in plants:
        if copy == 0:
            assert got[i].text == text[i]
        else:
            went[n_lines].append(got[i].text == rest and got[i].n_removed == n_lines)
    assert {n: sum(x) / len(x) for n, x in went.items()} == dict.fromkeys(range(1, 10), 1.0)


def test_passages_inside_long_lines_and_odd_rows(spark):
    rng = random.Random(3)
    shared = " ".join(sentence(rng, 20) for _ in range(3))
    own = [sentence(rng, 20) for _ in range(4)]
    short = "Yes. No."
    rows = [
        *odd_rows.ROWS,
        (100, f"{own[0]} {shared} {own[1]}\nend {short}", "en"),
        (101, f"{own[2]} {shared} {own[3]}\nend\n{short}", "en"),
        (102, f"{own[2]} {short} {own[3]}", "en"),
        (103, "a\n\nb 1", "en"), (104, "a\n\nb 2", "en"),  # one line and a line without words
        (None, f"x\n{shared}\ny", "en"),
    ]
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.passage_dedup(odd_rows.docs(spark, rows)).collect()]
    want = {101: (f"{own[2]} {own[3]}\nend\n{short}", 3, 0)}
    lines = lambda t: len(t.split("\n")) if t else 0
    expected = [(i, *want.get(i, (t, lines(t), 0))) for i, t, _ in rows[:-1]] + [(None, "x\ny", 3, 1)]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_different_windows_of_one_hash(spark, monkeypatch):
    rows, _ = planted(5, 2)
    docs = odd_rows.docs(spark, [*rows, *passages(4)])
    flat = lambda: sorted(map(tuple, line_dedup.passage_dedup(docs).collect()), key=str)
    want = flat()
    assert sum(r[-2] for r in want) > 50
    monkeypatch.setattr(line_dedup, "_window_hash", lambda *v: F.pmod(F.xxhash64(*v), F.lit(99)))
    assert flat() == want


def test_texts_of_windows_are_shuffled_once(spark):
    runs = line_dedup.repeated_runs(odd_rows.docs(spark, planted(5, 1)[0]))
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("body" in line for line in joins)


def test_words_between_any_blanks(one):
    for text in ("", " ", "a", " a\tb  c\r", "\x0b\x0ca\xa0b c", "a\nb"):
        assert one(line_dedup._n_words(F.col("t")), t=text) == len([w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w])


def test_words_without_other_blanks(one):
    for text in ("", " ", "a", " a b  c ", "a b c", "  a", "é ü", "a\xa0b c", "a\tb c"):
        words = [w for w in re.split("[ \t]+", text) if w]
        assert one(line_dedup._n_words(F.col("t"), line_dedup._other_blanks(F.col("t"))), t=text) == len(words)


def test_hashes_are_counted_without_texts(spark):
    rng = random.Random(8)
    long = " ".join(f"w{k}" for k in range(60))
    wide = "。".join(["好" * 60] * 3) + "！" + "x" * 30
    rows = [
        *odd_rows.ROWS, *passages(6), *planted(6, 1)[0],
        (100, f"{long}\n {long} \n{long}\tz", "en"), (101, wide, "zh"), (102, f"{wide}\n\n{long}. {long}", "zh"),
        (103, " ".join(sentence(rng, 15) for _ in range(9)), "en"),
    ]
    docs = odd_rows.docs(spark, rows)
    hashes = line_dedup.window_hashes(docs)
    assert hashes.columns == ["hash"]
    got = sorted(r.hash for r in hashes.collect())
    assert got == sorted(r.hash for r in line_dedup.windows(docs).select("hash").collect()) and len(got) > 100
