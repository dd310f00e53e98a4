import random
import zlib
from collections import Counter

import pytest

from copyloom.llm import spelling
from tests.llm import odd_rows

LETTERS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | {chr(c) for c in range(0xC0, 0x100)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least_length=7, least_count=2):
    """All pairs of words, one row after the other."""
    counts = Counter()
    for doc_id, text, _ in rows:
        run = ""
        for c in (text or "") + " ":
            if c in LETTERS:
                run += c.lower() if c < "\x80" else c
                continue
            if run:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                word = run
                if doc_id is not None and h % 31 == 0:
                    word = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[word] += 1
            run = ""
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def misspelt(n, seed=4):
    """Few frequent words, and rare words one and two edits from them."""
    rng = random.Random(seed)
    letters = "abcdefé×ÿß"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(40)]
    bag = ["abcabcab"] * 2 + ["abcabcabc"] * 25 + ["abcabcabcd"] * 300
    for w in base:
        bag += [w] * rng.choice([2, 20, 250])
        for _ in range(8):
            v = w
            for _ in range(rng.choice([1, 1, 2])):
                i, kind = rng.randrange(len(v) + 1), rng.randrange(3)
                v = v[:i] + ("" if kind == 0 else rng.choice(letters)) + v[i + (kind != 1) :]
            bag += [v] * rng.choice([1, 2, 3, 25])
    rng.shuffle(bag)
    return [(100 + i, " ".join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in bag[i::n]), "en") for i in range(n)]


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_all_pairs(spark):
    rows = [*misspelt(60), *odd_rows.ROWS]
    want = plain(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])
    assert got(spelling.variants(odd_rows.docs(spark, rows))) == want


@pytest.mark.parametrize("longest,frequent", [(2, 0), (3, 3), (5, 2), (7, 1), (7, 10**6)])
def test_any_dictionary_gives_all_pairs(spark, longest, frequent):
    words = sorted({w for _, t, _ in misspelt(5) for w in t.lower().split() if len(w) >= 7})
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n bigint")
    found = {(r.word, r.other) for r in spelling.near_words(frame, longest, frequent).collect()}
    assert found == {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and a != b and one_edit(a, b)}


def test_bound_of_affected_grams():
    rng = random.Random(2)
    frequent = {"".join(rng.choice("ab\x02\x03") for _ in range(k)): 9 for k in (2, 3, 4) for _ in range(30)}
    for _ in range(2000):
        w = "".join(rng.choice("ab") for _ in range(rng.randint(7, 10)))
        i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        v = w[:i] + ("" if kind == 0 else rng.choice("abc")) + w[i + (kind != 1) :]
        a, b = spelling.grams(w, frequent), spelling.grams(v, frequent)
        assert len(a) == len(w) + 1
        kept = Counter(g for _, g in a) & Counter(g for _, g in b)
        assert kept.total() >= len(a) - spelling.affected(a, len(w))


def test_chain_of_forms(spark):
    forms = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "e")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(w, "e") for w in "abcdx"}


def test_empty_and_odd(spark):
    assert got(spelling.variants(odd_rows.empty(spark))) == set()
    assert got(spelling.variants(odd_rows.docs(spark))) == plain(odd_rows.ROWS)
    # Hot word, one very long text, many equal rows.
    rows = [(i, "sameword " * 5 + "samewerd", "en") for i in range(300)] + [(999, "sameword " * 40_000 + "sameworld " * 3, None)]
    assert got(spelling.variants(odd_rows.docs(spark, rows))) == plain(rows)
    with pytest.raises(ValueError):
        spelling.variants(odd_rows.docs(spark), least_length=4)
