import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from copyloom.llm import packing, tokens
from copyloom.llm.tokens import coder, id_bytes
from tests.llm import odd_rows


@pytest.mark.parametrize("name, folds", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_are_those_of_the_whole_text(name, folds):
    c = coder(name, folds)
    rng = random.Random(3)
    signs = [
        "a", "B", "é", "\n", " ", "  ", ",", ".", "'s", "\t", " ", "1", "ª", "²", "日", "😀", "\x1c",
        "word", "İ", "Σ", "é", "́", "<|endoftext|>", "’", "\x00", "ß", "　", "-", "we're ",
    ]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    texts += [odd_rows.LONG, ""]
    assert c.encode(pa.array(texts)) == [c.whole(t) for t in texts]
    assert c.encode(pa.array([None], pa.string())) == [b""]
    assert c.encode(pa.array([], pa.string())) == []


def test_texts_are_encoded_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(tokens, "BATCH", 40)
    c = tokens.Coder("word_bpe_49k.json", True)
    sizes, whole = [], c._encode
    monkeypatch.setattr(c, "_encode", lambda texts: sizes.append(len(texts)) or whole(texts))
    texts = ["one two three four"] * 9 + ["five " * 30, None, ""]
    ids = c.each(pa.array(texts, pa.string()))
    assert next(ids) == c.whole(texts[0]) and sizes == [2]
    assert [*ids] == [c.whole(t or "") for t in texts[1:]] and sum(sizes) == len(texts)


@pytest.mark.parametrize(("name", "folds"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_new_words_go_through_the_tokenizer_a_few_at_a_time(name, folds, monkeypatch):
    class Watched:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, some, **how):
            sizes.append(len(some))
            return self.tokenizer.encode_batch_fast(some, **how)

    sizes = []
    monkeypatch.setattr(tokens, "LEARNT", 7)
    c = tokens.Coder(name, folds)
    c.bare, full = Watched(c.bare), Watched(c.tokenizer)
    text = " ".join(f"{chr(97 + i)}bc{chr(233 + i)}de\n{chr(97 + i)}xy, q{i}r" for i in range(20))
    whole = c.whole(text)
    c.tokenizer = full
    assert c.encode(pa.array([text])) == [whole]
    assert sum(sizes) > 7 and max(sizes) <= 7


def test_words_behind_blanks_go_as_one_text():
    c = tokens.Coder("byte_bpe_50k.json", False)
    words = [" house", " Éément", " ñquebo", " x", " \u0149x", " ſtraße", "\u01c5", "house", " ofthinglyon"]
    assert c._of_words(words) == {w: c.whole(w) for w in words}
    # Where the tokens don't say where words begin, each goes alone.
    c.begins = np.zeros(len(c.begins), bool)
    assert c._of_words(words) == {w: c.whole(w) for w in words}


def spread(runs):
    """All places of a plan: length → list of (bin, offset)."""
    return runs


def check_plan(counts, capacity):
    runs = packing.plan_bins(counts, capacity)
    total = sum(counts.values())
    firsts = [*runs[:, 0].tolist(), total]
    number_of, bins = 0, {}
    for (first, length, each, start, offset), upto in zip(runs.tolist(), firsts[1:]):
        assert first == number_of
        for i in range(upto - first):
            bins.setdefault(start + i // each, []).append((offset + i % each * length, length))
        number_of = upto
    placed = {}
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
            placed[length] = placed.get(length, 0) + 1
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in items) <= 2 or capacity < 3
    assert placed == {k: v for k, v in counts.items() if v}
    assert sorted(bins) == list(range(len(bins)))
    return bins


def best_fit(lengths, capacity):
    """Plain best fit by descending length, one item after the other."""
    gaps = []
    for s in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_plans_place_everything_and_fill_well():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([7, 30, 100, 4096])
        counts = {rng.randint(1, capacity): rng.choice([0, 1, 2, 7, 90]) for _ in range(rng.randint(1, 25))}
        bins = check_plan(counts, capacity)
        lengths = [s for s, n in counts.items() for _ in range(n)]
        assert len(bins) <= best_fit(lengths, capacity) * 1.05 + 1
        assert len(bins) >= -(-sum(lengths) // capacity)
    assert len(packing.plan_bins({}, 5)) == 0
    with pytest.raises(ValueError):
        packing.plan_bins({6: 1}, 5)


def test_large_items_are_matched_as_well_as_possible():
    from itertools import permutations

    rng = random.Random(2)
    for _ in range(40):
        lengths = [rng.randint(34, 99) for _ in range(7)]
        counts = {s: lengths.count(s) for s in lengths}

        def pairs(order):
            return sum(a + b <= 100 for a, b in zip(order[::2], order[1::2]))

        most = max(pairs(o) for o in permutations(lengths))
        assert len(check_plan(counts, 100)) == len(lengths) - most


def test_a_plan_does_not_grow_with_the_counts():
    counts = {s: 10**9 + s for s in range(1, 400)}
    assert len(packing.plan_bins(counts, 400)) < 20_000


def test_documents(spark):
    docs = odd_rows.docs(spark)
    got = packing.pack_documents(docs.withColumn("offset", docs.hash), capacity=16).collect()
    c = coder("word_bpe_49k.json", True)
    want = []
    for doc_id, text, _ in odd_rows.ROWS:
        ids = c.whole(text or "") + id_bytes([1])
        for piece, at in enumerate(range(0, len(ids), 64)):
            want.append((doc_id, piece, at // 4, len(ids[at : at + 64]) // 4, zlib.crc32(ids[at : at + 64])))
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in places.values():
        assert np.cumsum([0, *(n for _, n in sorted(items))]).tolist()[:-1] == [o for o, _ in sorted(items)]
        assert sum(n for _, n in items) <= 16
    assert packing.pack_documents(odd_rows.empty(spark)).collect() == []
