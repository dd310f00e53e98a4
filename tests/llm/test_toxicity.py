import random
import zlib

import numpy as np
import pytest

from copyloom.llm import toxicity, trees
from tests.llm import odd_rows


def test_trees_learn_what_no_single_feature_tells():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = trees.fit_trees(x[:2000], y[:2000], count=60)
    assert ((model.margins(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    assert len(model.margins(x[:0])) == 0


def test_calibration_rises_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    s = rng.normal(size=2000).round(1)
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * s))).astype(float)
    at, level = trees.fit_isotonic(s, y)
    assert (np.diff(at) > 0).all() and (np.diff(level) >= 0).all()
    assert abs(np.interp(s, at, level).mean() - y.mean()) < 0.02


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_splits_against_plain(depth):
    """No split of any feature gains more than the chosen ones (ties may go either way), and leaves hold plain steps."""
    rng = np.random.default_rng(depth)
    x = np.column_stack([rng.normal(size=120), rng.integers(0, 4, 120), np.ones(120), rng.random(120).round(1)])
    y = (rng.random(120) < np.where(x[:, 1] > 1, 0.7, 0.2)).astype(float)
    rate, smooth, bins = 0.3, 2.0, 8
    model = trees.fit_trees(x, y, count=1, depth=depth, rate=rate, bins=bins, smooth=smooth)
    share = sum(y) / len(y)
    slope, curve = [t - share for t in y], share * (1 - share)
    limits = [sorted(set(np.quantile(x[:, f], [k / bins for k in range(1, bins)]).tolist())) for f in range(4)]

    def gain(rows, f, limit):
        left, right = [i for i in rows if x[i, f] <= limit], [i for i in rows if x[i, f] > limit]
        if min(len(left), len(right)) * curve < 1:
            return 0.0
        weight = lambda some: sum(slope[i] for i in some) ** 2 / (curve * len(some) + smooth)
        return weight(left) + weight(right) - weight(rows)

    splits = 0
    reach = {0: list(range(120))}
    for node in range((1 << depth) - 1):
        rows, f, limit = reach[node], model.feature[0][node], model.limit[0][node]
        best = max((gain(rows, g, v) for g in range(4) for v in limits[g]), default=0.0)
        if np.isinf(limit):
            assert best < 1e-5
        else:
            assert limit in limits[f] and gain(rows, f, limit) > best - 1e-9
            splits += 1
        reach[2 * node + 1] = [i for i in rows if x[i, f] <= limit]
        reach[2 * node + 2] = [i for i in rows if x[i, f] > limit]
    assert splits >= depth
    margins = model.margins(x)
    for node in range((1 << depth) - 1, (1 << depth + 1) - 1):
        rows = reach[node]
        step = rate * sum(slope[i] for i in rows) / (curve * len(rows) + smooth)
        assert np.allclose(margins[rows], np.log(share / (1 - share)) + step)


def test_pools_against_plain():
    rng = np.random.default_rng(5)
    for weighted in (False, True):
        s = rng.integers(0, 30, 80).astype(float)
        y = (rng.random(80) < s / 30).astype(float)
        w = rng.integers(1, 5, 80).astype(float) if weighted else np.ones(80)
        levels = sorted(set(s))
        sums = [(sum(w[s == v]), sum((w * y)[s == v])) for v in levels]

        def mean(a, b):
            return sum(t for _, t in sums[a : b + 1]) / sum(n for n, _ in sums[a : b + 1])

        # The rising steps nearest to the means: the highest of the lowest means of all spans round a level.
        n = len(levels)
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        at, level = trees.fit_isotonic(s, y, w if weighted else None)
        assert np.allclose(np.interp(levels, at, level), want)


def test_features():
    n = len(toxicity.FEATURES)
    for text in ("", "?!", "a", "You IDIOT! y0u 1d10t st*pid sooo bad", odd_rows.LONG):
        found = dict(zip(toxicity.FEATURES, toxicity.features(text, {"bad": 2.0}, {"plon": 3.0})))
        assert len(found) == n and all(np.isfinite(v) for v in found.values())
    found = dict(zip(toxicity.FEATURES, toxicity.features("You are an idiot, plonker, sc*um", {"bad": 2.0}, {"plon": 3.0})))
    assert found["near_address"] > 0 and found["insults"] > 0 and found["stem_weight"] > 0 and found["disguised_hits"] > 0


def made(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bad = ["grobzak", "flumtor", "idiot"]
    rows, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.4)
        text = [rng.choice(words) for _ in range(rng.randint(10, 80))]
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((5000 + i, " ".join(text), "en"))
        labels.append((5000 + i, toxic))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, marks = made(500)
    labels = spark.createDataFrame([*marks, (None, 1), (5000, None), (77, 1), *marks[:3]], "doc_id bigint, toxic int")
    model = toxicity.fit(odd_rows.docs(spark, rows), labels)
    assert {"grobzak", "flumtor", "idiot"} <= set(model.words)
    got = {r.doc_id: r for r in toxicity.scored(odd_rows.docs(spark, [*rows, *odd_rows.ROWS]), model).collect()}
    held = [m for m in marks if zlib.crc32(str(m[0]).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == t for i, t in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert set(got) >= {i for i, _, _ in odd_rows.ROWS}


def test_without_labels(spark):
    docs = odd_rows.docs(spark)
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int"))
    assert model is None
    assert {(r.score, r.predicted) for r in toxicity.scored(docs, model).collect()} == {(0.0, 0)}


def test_scores_do_not_depend_on_the_size_of_the_sample(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(6000):
        toxic = int(rng.random() < 0.1)
        text = [f"w{rng.randint(0, 300)}" for _ in range(20)]
        if rng.random() < (0.7 if toxic else 0.12):
            text.insert(rng.randrange(20), "idiot")
        rows.append((i, " ".join(text), "en"))
        marks.append((i, toxic))
    docs, labels = odd_rows.docs(spark, rows).cache(), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    hit = np.array(["idiot" in t for _, t, _ in rows])
    means = []
    for per_label in (10**6, 300):
        got = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, labels, per_label)).collect()}
        s = np.array([got[i] for i, _, _ in rows])
        means.append((s[hit].mean(), s[~hit].mean()))
    assert abs(means[0][0] - means[1][0]) < 0.12 and abs(means[0][1] - means[1][1]) < 0.05
