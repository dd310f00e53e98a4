"""Toxicity of a text: boosted trees over dense features, with isotonic calibration.

Features are densities of a lexicon that is learned from labelled texts and of
a short fixed one, nearness to words of address, capitals, punctuation, and
signs of disguised spelling.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import held_out, share, ship, stored
from copyloom.llm.trees import Trees, fit_isotonic, fit_trees

# Common English insults, and words of address in four languages.
INSULTS = frozenset(
    "idiot moron stupid scum trash loser clown pathetic worthless disgusting dumb fool jerk"
    " garbage ugly imbecile filthy vermin".split()
)
ADDRESS = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine"
    " ihr euch euer tú ti tus usted ustedes vosotros".split()
)

#: Labelled documents of each class that are learned from, about; chosen by hash.
PER_LABEL = 8000
#: Entries of the learned lexicon, of each kind (words, and their first letters).
LEXICON = 2000
#: Documents that an entry has to occur in, and how much likelier in toxic ones (natural logarithm).
LEAST_DOCS, LEAST_ODDS = 4, 2.0
STEM = 4
NEAR = 3  # words to either side
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W_]+")
# Letters with digits or symbols between them; it starts at the start of a run only.
_DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[\d@$*|!]++[^\W\d_]++)++")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": ""})
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")

FEATURES = (
    "lexicon", "lexicon_weight", "lexicon_hits", "lexicon_kinds", "stems", "stem_weight", "insults",
    "near_address", "address", "capitals", "shouted", "exclaimed", "punctuation", "symbols",
    "disguised", "disguised_hits", "stretched", "single_letters", "words", "repeated",
)


def entries(text: str) -> set[tuple[str, str]]:
    """What a text offers to the lexicon: `word` and `stem` entries."""
    words = set(_WORD.findall(text.lower()))
    return {("word", w) for w in words} | {("stem", w[:STEM]) for w in words if len(w) > STEM}


def features(text: str, words: dict[str, float], stems: dict[str, float]) -> list[float]:
    """The dense features of a whole text; all 0 for an empty one."""
    lower = text.lower()
    found = _WORD.findall(lower)
    n = len(found)
    size = max(1, len(text))
    if not n:
        signs = sum(map(text.count, "!?"))
        return [0.0] * 11 + [signs / size, 1.0 if text.strip() else 0.0] + [0.0] * 7
    hits = [i for i, w in enumerate(found) if w in words or w in INSULTS]
    near = 0
    for i in hits:
        near += not ADDRESS.isdisjoint(found[max(0, i - NEAR) : i + NEAR + 1])
    stemmed = [s for s in (w[:STEM] for w in found if len(w) > STEM) if s in stems]
    disguised = _DISGUISED.findall(lower)
    plain = [d.translate(_LEET) for d in disguised]
    letters = sum(map(len, found))
    raw = np.frombuffer(text.encode(), np.uint8)
    original = _WORD.findall(text)
    return [
        len(hits) / n,
        sum(words.get(found[i], 1.0) for i in hits) / n,
        math.log1p(len(hits)),
        len({found[i] for i in hits}) / math.sqrt(n),
        len(stemmed) / n,
        sum(map(stems.__getitem__, stemmed)) / n,
        sum(w in INSULTS for w in found) / n,
        near / n,
        sum(w in ADDRESS for w in found) / n,
        int(np.count_nonzero((raw >= 65) & (raw <= 90))) / max(1, letters),
        sum(1 for w in original if len(w) > 3 and w.isupper()) / n,
        sum(map(text.count, "!?")) / size,
        sum(map(text.count, ".,;:!?'\"()-")) / size,
        sum(map(text.count, "#$%&*@|~^")) / size,
        len(disguised) / n,
        sum(1 for p in plain if p in words or p in INSULTS) / n,
        len(_LONG_RUN.findall(lower)) / n,
        sum(1 for w in found if len(w) == 1) / n,
        math.log1p(n),
        1 - len(set(found)) / n,
    ]


@dataclass(frozen=True)
class Model:
    """Lexicon with weights, trees and calibration points."""

    words: dict[str, float]
    stems: dict[str, float]
    trees: Trees
    points: tuple[np.ndarray, np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.margins(x), *self.points), 0, 1)


def _measured(texts: DataFrame, words: dict[str, float], stems: dict[str, float]) -> DataFrame:
    """`place, part, toxic, x` of a labelled sample."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, words, stems) for t in batch.column("text").to_pylist()]
            rest = batch.drop_columns(["text"])
            yield rest.append_column("x", pa.array(x, pa.list_(pa.float64())))

    return texts.select("place", "part", "toxic", "text").mapInArrow(
        measure, "place double, part int, toxic int, x array<double>"
    )


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """A model of `labels.toxic` (0 or 1), from about `per_label` documents of either label at most.

    Only documents outside the held-out fold count, and of a doc_id with several
    labels the largest. The sample is split by hash: the lexicon is learned from
    the first part, the trees from the second, the calibration from the third.
    Each label is sampled at its own rate, which the log-odds of the trees and
    the weights of the calibration undo, so that scores have the prior of all
    labels whatever the size of the sample. None if a label is missing in any part.
    """
    ship(docs.sparkSession)
    marks = (
        labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.when(F.col("toxic") == 1, per_label / max(1, counts.get(1, 0))).otherwise(per_label / max(1, counts.get(0, 0)))
    # Labels that a sampled one stands for.
    stands = {k: max(1.0, counts.get(k, 0) / per_label) for k in (0, 1)}
    chosen = marks.where(share(41, F.col("doc_id")) < rate).select("doc_id", F.col("toxic").cast("int"))
    # At most about twice `per_label` ids, so they can be broadcast.
    part = F.floor(share(42, F.col("doc_id")) * 5)
    sample = stored(
        docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select(
            share(43, F.col("doc_id")).alias("place"),
            F.when(part < 2, 0).when(part < 4, 1).otherwise(2).alias("part"),
            "toxic",
            "text",
        ),
        "labelled",
    )

    def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (kind, entry, toxic)
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist())
                for kind, entry in entries(text)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int32()))],
                    names=["kind", "entry", "toxic"],
                )

    first = sample.where("part = 0")
    size = {r["toxic"]: r["n"] for r in first.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    ranked = (
        first.select("text", "toxic")
        .mapInArrow(offered, "kind string, entry string, toxic int")
        .groupBy("kind", "entry")
        .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
        .where(F.col("bad") >= LEAST_DOCS)
        .withColumn("odds", odds)
        .where(F.col("odds") >= LEAST_ODDS)
    )
    words, stems = (
        {
            r["entry"]: r["odds"]
            for r in ranked.where(F.col("kind") == kind)
            .orderBy((F.col("odds") * F.sqrt("bad")).desc(), "entry")
            .limit(LEXICON)
            .collect()
        }
        for kind in ("word", "stem")
    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        table = table.sort_by("place")
        part, y = table["part"].to_numpy(), table["toxic"].to_numpy().astype(float)
        x = np.array(table["x"].to_pylist(), float).reshape(len(y), -1)
        learn, check = part == 1, part == 2
        if len(np.unique(y[learn])) < 2 or len(np.unique(y[check])) < 2:
            return
        trees = fit_trees(x[learn], y[learn])
        trees = replace(trees, base=trees.base + math.log(stands[1] / stands[0]))
        weights = np.where(y[check] == 1, stands[1], stands[0])
        at, level = fit_isotonic(trees.margins(x[check]), y[check], weights)
        yield pa.RecordBatch.from_pydict(
            {
                "feature": [trees.feature.ravel().tolist()],
                "cut": [trees.limit.ravel().tolist()],
                "value": [trees.value.ravel().tolist()],
                "trees": [len(trees.value)],
                "base": [trees.base],
                "at": [at.tolist()],
                "level": [level.tolist()],
            }
        )

    measured = stored(_measured(sample.where("part > 0"), words, stems), "labelled-features")
    made = measured.coalesce(1).mapInArrow(
        train,
        "feature array<bigint>, cut array<double>, value array<double>, trees bigint, base double,"
        " at array<double>, level array<double>",
    )
    found = stored(made, "toxicity-model").first()
    if found is None:
        return None
    count = found["trees"]
    trees = Trees(*(np.array(found[c]).reshape(count, -1) for c in ("feature", "cut", "value")), found["base"])
    return Model(words, stems, trees, (np.array(found["at"]), np.array(found["level"])))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """`doc_id, score, predicted` of every whole text; a null text is empty.

    Without a model all scores are 0. Every row gives a row; other columns don't
    matter.
    """
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [features(t or "", model.words, model.stems) for t in batch.column("text").to_pylist()]
            s = model.scores(np.array(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        score, "doc_id bigint, score double, predicted int"
    )
