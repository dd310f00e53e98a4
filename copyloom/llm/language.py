"""Language of a text: averaged embeddings of hashed subwords under a linear softmax.

Subwords are runs of 2 to 4 bytes of the lower-cased text, white space included.
As the average is linear, embedding and output layer fold into one table of
logits per subword bucket, with which whole texts are scored.

Beside the languages the softmax has a class for what is none of them. It is
trained on noise made from the same texts: their letters in any order, any
letters, letters of other scripts, signs and digits. Texts are rejected by the
chance of this class, at a threshold set on texts kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import fresh, give_back, held_out, share, ship, stored
from copyloom.llm.tokens import forget

BUCKETS = 1 << 15  # a bucket's number takes two bytes
LENGTHS = (2, 3, 4)
UNKNOWN = "und"

#: Bytes of text that are scored at a time; a longer text is taken in slices.
SLICE = 500_000

#: Documents per language that the model is fitted to, about; chosen by hash.
PER_LANGUAGE = 2000
#: Values of `lang` that may be broadcast with their counts.
BROADCAST_ROWS = 100_000
#: Of the calibration texts in a language, the share that rejection may lose.
LOST = 0.001
#: The share of sampled texts of which noise is made as well.
NOISE = 0.3
#: First letters of the scripts that noise is written in, and how many of them are taken.
SCRIPTS = (0x3B1, 0x430, 0x561, 0x5D0, 0x627, 0x905, 0xE01, 0x10D0, 0x3041, 0x30A1, 0x4E00, 0xAC00)
SCRIPT_LETTERS = 24


@dataclass(frozen=True)
class Model:
    """Languages, logits per bucket, bias and temperature, and the highest chance of no language accepted.

    The last class is that of no language.
    """

    languages: list[str]
    table: np.ndarray  # buckets x (languages and no language)
    bias: np.ndarray
    temperature: float
    most: float

    def scores(self, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of the languages among each other, and of no language, from summed logits and numbers of subwords."""
        z = sums / np.maximum(counts, 1)[:, None] + self.bias
        return _chances(z[:, :-1], self.temperature), _chances(z, self.temperature)[:, -1]


def _chances(logits: np.ndarray, temperature: float) -> np.ndarray:
    z = logits / temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def noise(text: str, seed: int) -> str:
    """A text in no language, made from a lower-cased one; which kind of noise depends on the seed."""
    rng = np.random.default_rng(seed)
    kind = seed % 4
    # Any part of it, so that short texts are among them.
    size = int(rng.integers(1, max(2, len(text) + 1)))
    at = int(rng.integers(0, max(1, len(text) - size + 1)))
    signs = np.array(list(text[at : at + size]) or ["0"])
    letters = np.char.isalpha(signs)
    n = int(letters.sum())
    if kind == 0:
        signs[letters] = rng.permutation(signs[letters])
    elif kind == 1:
        signs[letters] = np.array(list("abcdefghijklmnopqrstuvwxyz"))[rng.integers(0, 26, n)]
    elif kind == 2:
        first = SCRIPTS[int(rng.integers(0, len(SCRIPTS)))]
        signs[letters] = [chr(first + i) for i in rng.integers(0, SCRIPT_LETTERS, n).tolist()]
    else:
        signs[letters] = np.array(list("0123456789-_=/<>|#"))[rng.integers(0, 18, n)]
    return "".join(signs.tolist())


def _buckets(data: np.ndarray, length: int) -> np.ndarray:
    """Bucket of each run of `length` bytes."""
    n = max(0, len(data) - length + 1)
    run = np.zeros(n, np.uint32)
    for k in range(length):
        run = (run << np.uint32(8)) | data[k : k + n]
    run = (run + np.uint32(length * 0x1000193)) * np.uint32(2_654_435_761)
    return (run ^ (run >> np.uint32(15))) * np.uint32(2_246_822_519) >> np.uint32(17)


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The bytes of some texts at a time: first text, bytes, offsets. Long texts overlap in slices."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        if upto == at + 1:
            yield at, data[offsets[at] : offsets[upto]], np.array([0, offsets[upto] - offsets[at]])
        else:
            yield at, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def summed(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed logits and number of subwords of each text."""
    sums = np.zeros((len(texts), table.shape[1]))
    counts = np.zeros(len(texts), np.int64)
    columns = [np.ascontiguousarray(c) for c in table.T.astype(np.float32)]
    for first, data, offsets in _slices(texts):
        for piece in range(0, len(data), SLICE):
            part = data[piece : piece + SLICE + max(LENGTHS) - 1]
            for length in LENGTHS:
                bucket = _buckets(part, length)[:SLICE]
                # Runs that stay within a text: from its start to its end less the run.
                starts = np.clip(offsets[:-1] - piece, 0, len(bucket))
                ends = np.clip(offsets[1:] - piece - length + 1, starts, len(bucket))
                counts[first : first + len(starts)] += ends - starts
                for c, column in enumerate(columns):
                    running = np.zeros(len(bucket) + 1)
                    np.cumsum(column[bucket], dtype=np.float64, out=running[1:])
                    sums[first : first + len(starts), c] += running[ends] - running[starts]
    return sums, counts


def _counted(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text with their shares."""
    for text in texts:
        data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
        total = np.zeros(BUCKETS, np.int64)
        for piece in range(0, len(data), SLICE):
            part = data[piece : piece + SLICE + max(LENGTHS) - 1]
            for length in LENGTHS:
                total += np.bincount(_buckets(part, length)[:SLICE], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield at, total[at] / max(1, total.sum())


def fit_softmax(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    classes: int,
    size: int = 16,
    rounds: int = 12,
    rate: float = 2.0,
) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent on averaged embeddings: logit table and bias."""
    rng = np.random.default_rng(9)
    embed = rng.normal(0, 1, (BUCKETS, size)).astype(np.float32)
    out = np.zeros((size, classes), np.float32)
    bias = np.zeros(classes, np.float32)
    step, batch = 0, 32
    steps = max(1, rounds * len(rows) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            x = np.zeros((len(some), BUCKETS), np.float32)
            for i, r in enumerate(some):
                x[i, rows[r][0]] = rows[r][1]
            mean = x @ embed
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            speed = np.float32(rate * max(0.05, 1 - step / steps) / len(some))
            back = p @ out.T
            out -= speed * (mean.T @ p)
            bias -= speed * p.sum(axis=0)
            # Each subword has a small share of an average, so embeddings learn faster.
            embed -= speed * 50 * (x.T @ back)
            step += 1
    return embed @ out, bias


def _fitted(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
    """The model of some `lang, at, share, place`, as one row; none without a language."""
    taken = [
        (place, lang, np.array(at, np.uint16), np.array(part, np.float32))
        for b in batches
        for lang, at, part, place in zip(
            b.column("lang").to_pylist(),
            (x.values.to_numpy(zero_copy_only=False) for x in b.column("at")),
            (x.values.to_numpy(zero_copy_only=False) for x in b.column("share")),
            b.column("place").to_pylist(),
        )
    ]
    taken.sort(key=lambda t: (t[0], t[1] is None, t[1] or ""))
    languages = sorted({t[1] for t in taken if t[1] is not None})
    if not languages:
        return None
    none = len(languages)
    labels = np.array([none if t[1] is None else languages.index(t[1]) for t in taken])
    apart = np.arange(len(taken)) % 5 == 4
    rows = [t[2:] for t in taken]
    learn = np.flatnonzero(~apart)
    table, bias = fit_softmax([rows[i] for i in learn], labels[learn], none + 1)
    check = np.flatnonzero(apart & (labels < none))
    check = check if len(check) else np.flatnonzero(labels < none)
    logits = np.array([part @ table[at] for at, part in (rows[i] for i in check)]) + bias
    target = labels[check]

    def loss(temperature: float) -> float:
        return -np.log(_chances(logits[:, :none], temperature)[np.arange(len(target)), target] + 1e-12).mean()

    temperature = min(np.geomspace(0.05, 20, 61), key=loss)
    apart_from = np.sort(_chances(logits, temperature)[:, none])
    most = max(0.5, float(apart_from[len(apart_from) - 1 - int(LOST * len(apart_from))]))
    return pa.RecordBatch.from_pydict(
        {
            "languages": [languages],
            "logits": [table.astype("<f4").tobytes()],
            "bias": [bias.astype("<f4").tobytes()],
            "temperature": [float(temperature)],
            "most": [most],
        }
    )


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    made = _fitted(batches)
    if made is not None:
        yield made
    # Whole samples were held: the scoring tasks would start on top of them.
    give_back()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of `lang`, from at most about `per_language` documents of each language.

    Uses `text` and non-null `lang` of documents outside the held-out fold. A
    fifth of the sample is kept apart to calibrate: the temperature is the one
    under which its right answers are likeliest, and the highest accepted chance
    of no language is at least a half and loses no more than `LOST` of its texts.
    Without any such document the model knows no language.
    """
    ship(docs.sparkSession)
    known = docs.where(~held_out(F.col("doc_id"))).where("lang is not null and text is not null")
    counts = stored(known.groupBy("lang").agg(F.count(F.lit(1)).alias("_of")), "languages")
    # One row per language: broadcast, unless there are more than languages can be.
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    sample = known.select("lang", "text", "doc_id").join(counts, "lang").where(
        share(91, F.col("doc_id"), F.col("lang")) < F.lit(float(per_language)) / F.col("_of")
    )
    schema = pa.schema(
        [("lang", pa.string()), ("at", pa.list_(pa.int32())), ("share", pa.list_(pa.float32())), ("place", pa.float64())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(lang: pa.Array, texts: pa.Array, place: pa.Array) -> pa.RecordBatch:
            pairs = list(_counted(texts))
            at = pa.array([p[0].astype(np.int32) for p in pairs], schema.field("at").type)
            shares = pa.array([p[1].astype(np.float32) for p in pairs], schema.field("share").type)
            return pa.RecordBatch.from_arrays([lang, at, shares, place], schema=schema)

        forget()
        for batch in batches:
            yield out(batch.column("lang"), batch.column("text"), batch.column("place"))
            # The digits behind those that choose a text choose its noise.
            some = batch.filter(pa.array([p < NOISE for p in batch.column("place").to_pylist()], pa.bool_()))
            made = [
                noise(t, int(p * (1 << 40)))
                for t, p in zip(some.column("text").to_pylist(), some.column("place").to_pylist())
            ]
            yield out(pa.nulls(len(made), pa.string()), pa.array(made, pa.string()), some.column("place"))
        give_back()

    placed = sample.select("lang", F.lower("text").alias("text"), share(92, F.col("doc_id")).alias("place"))
    features = stored(
        placed.mapInArrow(count, "lang string, at array<int>, share array<float>, place double"), "language-sample"
    )

    made = features.coalesce(1).mapInArrow(
        _train, "languages array<string>, logits binary, bias binary, temperature double, most double"
    )
    found = stored(made, "language-model").first()
    if found is None:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), 1.0, 0.5)
    table = np.frombuffer(found["logits"], "<f4").reshape(BUCKETS, -1)
    return Model(
        list(found["languages"]), table, np.frombuffer(found["bias"], "<f4"), found["temperature"], found["most"]
    )


def detected(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` (with `text`) and `lang_pred, lang_score, lang_accepted`.

    `und` with score 0 for a null text, one without letters, and under a model
    without languages. Texts count as accepted if they have a language and the
    chance that they are in none is at most the model's. Columns of these three
    names are replaced. Every row is judged by its own text alone, repeated rows
    too; long texts are scored whole, in slices; an empty table stays empty.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("lang_pred", "lang_score", "lang_accepted")
    lower, lettered = fresh(docs, "_lower", "_letters")
    shared = spark.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model = shared.value
        for batch in batches:
            letters = batch.column(lettered).to_numpy(zero_copy_only=False)
            best, top = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if model.languages:
                p, none = model.scores(*summed(batch.column(lower), model.table))
                top = np.where(letters, p.max(axis=1), 0.0)
                best = [model.languages[i] if ok else UNKNOWN for i, ok in zip(p.argmax(axis=1), letters)]
                letters = letters & (none <= model.most)
            else:
                letters = np.zeros(batch.num_rows, bool)
            batch = batch.drop_columns([lower, lettered])
            batch = batch.append_column("lang_pred", pa.array(best, pa.string()))
            batch = batch.append_column("lang_score", pa.array(top, pa.float64()))
            yield batch.append_column("lang_accepted", pa.array(letters, pa.bool_()))
        give_back()

    return docs.withColumns(
        {lower: F.lower("text"), lettered: F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))}
    ).mapInArrow(score, f"{fields}, lang_pred string, lang_score double, lang_accepted boolean")
