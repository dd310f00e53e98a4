import random
import re
from collections import Counter

import numpy as np

from copyloom.llm import collocations as co
from tests.llm import odd_rows


def split(text):
    lower = (text or "").encode().lower().decode()
    return [[w for w in re.split("[ \t]", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", lower)]


def counted(rows, longest):
    counts = {}
    for _, text, lang in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in split(text):
            for m in range(1, longest + 1):
                own.update(tuple(piece[i : i + m]) for i in range(len(piece) - m + 1))
    return counts


def plain(rows, longest=3, least=10, top=2000, inside=50):
    out = set()
    for lang, f in counted(rows, longest).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        good = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in good.items():
            longer = [c for q, c in good.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * c >= inside * a for c in longer):
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return out


def texts(n, seed=7):
    rng = random.Random(seed)
    words = [*"the of und é naïve İ big red house river x y z".split(), "new york", "new york city", "a b c d"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 40)):
            w = words[min(int(rng.expovariate(0.25)), len(words) - 1)]
            parts.append((w.upper() if rng.random() < 0.2 else w) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "!? "]))
        rows.append((500 + i, "".join(parts), rng.choice(["en", "en", "de", None, ""])))
    return rows


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_plain_counts(spark):
    rows = [*texts(400), *odd_rows.ROWS]
    want = plain(rows)
    assert len(want) > 50 and any(" " in r[2] and r[2].count(" ") == 2 for r in want)
    assert got(co.collocations(odd_rows.docs(spark, rows))) == want
    want = plain(rows, 4, 4, 9, 80)
    assert got(co.collocations(odd_rows.docs(spark, rows), 4, 4, 9, 80)) == want


def test_small_shards_give_the_same(spark, monkeypatch):
    rows = [*texts(200, 3), (1, "long piece " * 3000 + ". " + "new york " * 50, "en")]
    docs = odd_rows.docs(spark, rows)
    held = co.shards(docs.repartition(3), 700).collect()
    assert len(held) > 20
    again = {}
    for r in held:
        numbers, words = co.unpacked(r["numbers"], r["words"])
        words = words.to_pylist()
        own = again.setdefault(r["lang"], Counter())
        for piece in np.split(numbers, np.flatnonzero(numbers == 0)):
            ws = [words[i - 1] for i in piece if i]
            for m in (1, 2, 3):
                own.update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    assert {k: v for k, v in again.items() if v} == {k: v for k, v in counted(rows, 3).items() if v}
    small = co.shards
    monkeypatch.setattr(co, "shards", lambda d: small(d, 700))
    monkeypatch.setattr(co, "BUCKET", 1000)
    assert got(co.collocations(docs.repartition(3))) == plain(rows)


def test_phrases_go_back_to_shards_packed(spark, monkeypatch):
    rows = texts(200, 3)
    docs = odd_rows.docs(spark, rows).repartition(3)
    small, store = co.shards, co.stored
    sizes = {}

    def kept(df, name):
        out = store(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(co, "shards", lambda d: small(d, 700))
    monkeypatch.setattr(co, "stored", kept)
    assert got(co.collocations(docs)) == plain(rows)
    (n_shards,) = sizes.pop("shards")
    frequent = sum(c >= 10 for f in counted(rows, 3).values() for c in f.values())
    # A row for each word and shard once; of longer phrases none for each phrase and shard.
    sizes.pop("words", None)
    assert n_shards > 20 and all(n <= max(frequent, n_shards * 3) for x in sizes.values() for n in x)


def test_intervals_are_counts():
    rng = random.Random(1)
    data = " ".join(rng.choice("abcdefg,") for _ in range(3000)).encode()
    numbers, words = co.sequence(data)
    assert numbers[0] == numbers[-1] == 0
    names = words.to_pylist()
    index, back = co.Index(numbers, 3), co.Index(numbers[::-1], 3)
    known = np.arange(1, len(names) + 1)[:, None]
    want = counted([(0, data.decode(), "x")], 4)["x"]
    for _ in range(3):
        for row, a, b in zip(known, *co.extensions(numbers, known, 3)):
            p = tuple(names[i - 1] for i in row)
            assert a == sum(want[(w, *p)] for w in names) and b == sum(want[(*p, w)] for w in names)
        if known.shape[1] == 3:
            break
        longer, low, low_back, n = co.grown(index, back, known)
        assert all((x == y).all() for x, y in zip(index.search(longer), (low, n)))
        assert all((x == y).all() for x, y in zip(back.search(longer[:, ::-1]), (low_back, n)))
        assert {tuple(names[i - 1] for i in row): c for row, c in zip(longer, n)} == {
            p: c for p, c in want.items() if len(p) == longer.shape[1]
        }
        head, tail, same = co.counts_of_longer(numbers, known, 3)
        assert (np.column_stack([known[head], known[tail][:, -1]]) == longer).all() and (same == n).all()
        known = longer


def test_sides_of_phrases(spark):
    rows = [(i, "big new york. new york city, new york", "en") for i in range(12)]
    counts, totals = co.phrase_counts(odd_rows.docs(spark, rows), sides=True)
    assert {(r["phrase"], r["f"], r["before"], r["behind"]) for r in counts.collect() if r["words"] > 1} == {
        ("big new", 12, 0, 12), ("new york", 36, 12, 12), ("york city", 12, 12, 0),
        ("big new york", 12, 0, 0), ("new york city", 12, 0, 0),
    }
    assert [tuple(r) for r in totals.collect()] == [("en", 96)]


def test_empty(spark):
    assert got(co.collocations(odd_rows.empty(spark))) == set()
    assert got(co.collocations(odd_rows.docs(spark))) == plain(odd_rows.ROWS)
