import random
import zlib

import numpy as np
import pyarrow as pa

from copyloom.llm import language
from tests.llm import odd_rows

WORDS = {"aa": "the and with tion ing house of river".split(), "bb": "der und mit keit schön fluß haus ein".split()}


def texts(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((2000 + i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = texts(300)
    docs = odd_rows.docs(spark, rows)
    model = language.fit(docs)
    assert model.languages == ["aa", "bb"] and 0.5 <= model.most < 1
    got = language.detected(odd_rows.docs(spark, [*rows, *odd_rows.ROWS]), model)
    assert got.columns == [*docs.columns, "lang_pred", "lang_score", "lang_accepted"]
    told = {r.doc_id: r for r in got.collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([told[i].lang_pred == lang for i, _, lang in held]) > 0.97
    for i in (3, 4, 8, 9):
        assert (told[i].lang_pred, told[i].lang_score, told[i].lang_accepted) == ("und", 0.0, False)
    assert all(0 <= r.lang_score <= 1 for r in told.values())


def test_no_label_is_read_from_the_held_out_fold(spark):
    rows = [(i, "the and", "aa" if zlib.crc32(str(i).encode()) % 3 != 1 else "secret") for i in range(60)]
    assert language.fit(odd_rows.docs(spark, rows)).languages == ["aa"]


def test_sums_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(0)
    table = rng.normal(size=(language.BUCKETS, 3)).astype(np.float32)
    some = pa.array([t for _, t, _ in odd_rows.ROWS if t is not None] + [None, "ab", "x"])
    whole = language.summed(some, table)
    monkeypatch.setattr(language, "SLICE", 11)
    parts = language.summed(some, table)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()
    for text, n in zip(some.to_pylist(), whole[1]):
        size = len((text or "").encode())
        assert n == sum(max(0, size - k + 1) for k in language.LENGTHS)


def test_without_labels(spark):
    model = language.fit(odd_rows.empty(spark))
    assert model.languages == []
    got = language.detected(odd_rows.docs(spark), model).collect()
    assert len(got) == len(odd_rows.ROWS) and {r.lang_pred for r in got} == {"und"}


def test_descent_against_plain(monkeypatch):
    """Each step by plain sums: the softmax, then the embeddings by the weights before it."""
    monkeypatch.setattr(language, "BUCKETS", 6)
    rng = np.random.default_rng(11)
    rows = [(np.flatnonzero(rng.random(6) < 0.6), None) for _ in range(50)]
    rows = [(at, rng.dirichlet(np.ones(len(at))).astype(np.float32) if len(at) else np.zeros(0, np.float32)) for at, _ in rows]
    labels = rng.integers(0, 3, 50)
    size, rounds, rate = 4, 3, 0.5
    own = np.random.default_rng(9)
    embed = own.normal(0, 1, (6, size)).tolist()
    out, bias = [[0.0] * 3 for _ in range(size)], [0.0] * 3
    steps, step = rounds * 50 // 32, 0
    for _ in range(rounds):
        order = own.permutation(50)
        for some in (order[:32], order[32:]):
            speed = rate * max(0.05, 1 - step / steps) / len(some)
            d_embed, d_out, d_bias = np.zeros((6, size)), np.zeros((size, 3)), np.zeros(3)
            for i in some:
                at, part = rows[i]
                mean = [sum(float(w) * embed[b][d] for b, w in zip(at, part)) for d in range(size)]
                z = [sum(mean[d] * out[d][c] for d in range(size)) + bias[c] for c in range(3)]
                e = [np.exp(v - max(z)) for v in z]
                off = [v / sum(e) - (c == labels[i]) for c, v in enumerate(e)]
                for c in range(3):
                    d_bias[c] += off[c]
                    for d in range(size):
                        d_out[d][c] += mean[d] * off[c]
                        for b, w in zip(at, part):
                            d_embed[b][d] += float(w) * off[c] * out[d][c]
            embed = (np.array(embed) - speed * 50 * d_embed).tolist()
            out = (np.array(out) - speed * d_out).tolist()
            bias = (np.array(bias) - speed * d_bias).tolist()
            step += 1
    table, found = language.fit_softmax(rows, labels, 3, size, rounds, rate)
    want = np.array(embed) @ np.array(out)
    assert np.allclose(table, want, atol=1e-3 * max(1, abs(want).max())) and np.allclose(found, bias, atol=1e-3)


def test_what_is_no_language_is_rejected_and_the_rest_is_not(spark):
    rows = texts(600, seed=2)
    model = language.fit(odd_rows.docs(spark, rows))
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    odd = [
        "これは日本語の文章です。とても短いですが、いくつかの文があります。", "это предложение на русском языке", "1010 a",
        *["".join(rng.choice(letters + "   ") for _ in range(200)) for _ in range(20)],
    ]
    docs = odd_rows.docs(spark, [*rows, *[(9000 + i, t, None) for i, t in enumerate(odd)]])
    told = {r.doc_id: r.lang_accepted for r in language.detected(docs, model).collect()}
    assert not any(told[9000 + i] for i in range(len(odd)))
    assert np.mean([told[i] for i, _, _ in rows]) > 0.98


def test_scores_against_plain(spark):
    rows = texts(120, seed=4)
    model = language.fit(odd_rows.docs(spark, rows))
    docs = odd_rows.docs(spark, [*rows[:30], (1, "é", "aa")]).withColumnsRenamed({"row": "_lower", "hash": "_letters"})
    for r in language.detected(docs, model).collect():
        assert (r["_lower"], r["_letters"]) == ("r", None)
        data = r.text.lower().encode()
        runs = [data[i : i + k] for k in language.LENGTHS for i in range(len(data) - k + 1)]
        z = model.bias.astype(float)
        for run in runs:
            number = int.from_bytes(run, "big") + len(run) * 0x1000193
            number = number * 2_654_435_761 % 2**32
            number = (number ^ number >> 15) * 2_246_822_519 % 2**32 >> 17
            z = z + model.table[number] / len(runs)
        p = np.exp((z[:-1] - z.max()) / model.temperature)
        assert abs(r.lang_score - (p / p.sum()).max()) < 1e-4
        assert r.lang_pred == model.languages[int(p.argmax())]


def test_training_drops_what_an_operator_before_kept():
    from copyloom.llm import tokens

    tokens._coders["vocabulary", True] = object()
    assert list(language._train(iter(()))) == []
    assert not tokens._coders


def test_memory_of_training():
    import tracemalloc

    rng = np.random.default_rng(1)
    n, each = 400, 3000
    schema = pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int32())), ("share", pa.list_(pa.float32())), ("place", pa.float64())])

    def batches():
        for at in range(0, n, 50):
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": [("aa", "bb", None)[i % 3] for i in range(50)],
                    "at": [rng.permutation(language.BUCKETS)[:each] for _ in range(50)],
                    "share": [np.full(each, 1 / each, np.float32) for _ in range(50)],
                    "place": [float(at + i) for i in range(50)],
                },
                schema=schema,
            )

    held = []

    def softmax(rows, labels, classes):
        held.append(tracemalloc.get_traced_memory()[0])
        return np.zeros((language.BUCKETS, classes), np.float32), np.zeros(classes, np.float32)

    plain, language.fit_softmax = language.fit_softmax, softmax
    tracemalloc.start()
    try:
        assert [b.num_rows for b in language._train(batches())] == [1]
    finally:
        tracemalloc.stop()
        language.fit_softmax = plain
    assert held[0] < n * each * 8
