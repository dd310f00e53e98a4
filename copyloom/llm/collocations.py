"""Phrases that stand together: counts by FM-indexes over word ids, summed over shards.

A task cuts its texts into shards of one language each, numbers the words of a
shard, and stores the sequence of numbers, in which 0 stands between pieces. A
shard's index is a pair of Burrows-Wheeler transforms, of the sequence and of its
reverse, sorted as deep as phrases get. A phrase is an interval in either. Adding
a word on the right is a backward step in the reverse index; the interval in the
other one moves by the places whose next word is smaller.

Phrases grow a word at a time. Those of a shard are summed over all shards before
they grow, and only those that are frequent in the language go on: a phrase is at
most as frequent as its parts, so none is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from copyloom.llm.common import ship, stored

LONGEST = 3  # words in a phrase
LEAST = 10  # occurrences of a candidate
TOP = 2000
#: A phrase goes if a longer one has at least this share (per cent) of its occurrences.
INSIDE = 50
UNKNOWN = "und"

#: Bytes of text in a shard, which is cut between pieces; a longer piece is a shard of its own.
SHARD = 8_000_000
#: Bytes of text that a task holds in unfinished shards of its languages.
HELD = 32_000_000
#: Places in all texts for which there is a bucket of phrases; one task sums a bucket.
BUCKET = 2_000_000

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_SPACE = _PIECE_END.copy()
_SPACE[[32, 9]] = True
_FOLD = np.frombuffer(bytes(range(256)).lower(), np.uint8)  # A-Z only


def sequence(data: bytes) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the words of a text from 1, with 0 between pieces and at both ends; the words.

    All separators are ASCII, so bytes can be told apart without decoding.
    """
    raw = np.frombuffer(data, np.uint8)
    solid = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(1, np.int32), pa.array([], pa.large_string())
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    kept = _FOLD[raw[solid]]
    words = pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes())]
    )
    coded = words.dictionary_encode()
    numbers = coded.indices.to_numpy().astype(np.int32) + 1
    new_piece = np.flatnonzero(np.diff(np.cumsum(_PIECE_END[raw])[starts])) + 1
    return np.pad(np.insert(numbers, new_piece, 0), 1), coded.dictionary


class Index:
    """The transform of a sequence of word numbers, 0 at both ends, sorted `depth` words deep."""

    def __init__(self, numbers: np.ndarray, depth: int) -> None:
        self.n, self.size = len(numbers), int(numbers.max()) + 1
        order = np.lexsort([np.roll(numbers, -k) for k in reversed(range(depth))])
        self.last = numbers[order - 1]  # the word before each sorted place
        counts = np.bincount(numbers, minlength=self.size)
        #: Where the places that begin with a word begin; as many have it as `last`.
        self.first = np.concatenate([[0], np.cumsum(counts)])
        by_word = np.argsort(self.last, kind="stable")
        self._keys = self.last[by_word].astype(np.int64) * self.n + by_word

    def rank(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often each word is in `last` before the given row."""
        return np.searchsorted(self._keys, words.astype(np.int64) * self.n + rows) - self.first[words]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the interval of each row of words begins, and its places; word by word from the last."""
        low, high = self.first[phrases[:, -1]], self.first[phrases[:, -1] + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            words = phrases[:, k]
            low, high = (self.first[words] + self.rank(words, x) for x in (low, high))
        return low, high - low

    def step(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each interval with each word that stands before it.

        The interval's place in the input, the word, the number of places, where
        the new interval begins, and how many places of the old one have a
        smaller word.
        """
        which = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        keys, counts = np.unique(which * np.int64(self.size) + self.last[rows], return_counts=True)
        which, word = keys // self.size, keys % self.size
        before = np.cumsum(counts) - counts
        smaller = before - before[np.searchsorted(which, which)]
        return which, word, counts, self.first[word] + self.rank(word, low[which]), smaller


def _places(rows: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the known rows of numbers, all different, each row is; -1 for others."""
    both = np.concatenate([known, rows]).astype(np.int64)
    key = both[:, 0]
    for k in range(1, both.shape[1]):
        key = np.unique(key * (both[:, k].max(initial=0) + 1) + both[:, k], return_inverse=True)[1]
    order = np.argsort(key[: len(known)])
    sorted_keys, wanted = key[order], key[len(known) :]
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(known) - 1)
    return np.where(sorted_keys[at] == wanted, order[at], -1)


def grown(index: Index, back: Index, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases one word longer, on the right, whose words but the first are a known phrase as well.

    `known` has a row of word numbers for each known phrase. Of the longer ones:
    the same, their intervals in the index and the reverse one, and their counts.
    """
    low, _ = index.search(known)
    low_back, n = back.search(known[:, ::-1])
    which, word, counts, begin, smaller = back.step(low_back, n)
    longer = np.column_stack([known[which], word])
    kept = (word > 0) & (_places(longer[:, 1:], known) >= 0)
    return longer[kept], (low[which] + smaller)[kept], begin[kept], counts[kept]


def counts_of_longer(numbers: np.ndarray, known: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longer phrases of `grown`, for which the reverse index is enough.

    Which known phrase each one begins with, which one it ends with, and its count.
    """
    back = Index(numbers[::-1], depth)
    which, word, counts, _, _ = back.step(*back.search(known[:, ::-1]))
    ends = _places(np.column_stack([known[which], word])[:, 1:], known)
    kept = (word > 0) & (ends >= 0)
    return which[kept], ends[kept], counts[kept]


def extensions(numbers: np.ndarray, known: np.ndarray, depth: int) -> list[np.ndarray]:
    """Of each phrase, the occurrences that have a word before, and behind, in their piece."""
    found = []
    for index, rows in ((Index(numbers, depth), known), (Index(numbers[::-1], depth), known[:, ::-1])):
        low, n = index.search(rows)
        running = np.concatenate([[0], np.cumsum(index.last > 0)])
        found.append(running[low + n] - running[low])
    return found


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """`text, lang` → `shard, lang, numbers, words`: each shard's sequence (int32) and words, line by line, as zstd frames."""
    ship(docs.sparkSession)
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("numbers", pa.binary()), ("words", pa.binary())])

    def out(lang: str, data: bytes) -> pa.RecordBatch:
        numbers, words = sequence(data)
        packer = zstandard.ZstdCompressor(3)
        frames = packer.compress(numbers.astype("<i4").tobytes()), packer.compress("\n".join(words.to_pylist()).encode())
        row = (uuid.uuid4().int >> 65, lang, *frames)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, bytearray] = {}
        total = 0
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                name = lang.as_py() if lang.is_valid else UNKNOWN
                own = held.setdefault(name, bytearray())
                data = (text.as_py() or "").encode() + b"\n"
                own += data
                total += len(data)
                while len(own) >= size:
                    within = np.flatnonzero(_PIECE_END[np.frombuffer(bytes(own[:size]), np.uint8)])
                    cut = int(within[-1]) + 1 if len(within) else min(i for e in b".,;:!?\n\x0b\x0c\r" if (i := own.find(e, size)) >= 0) + 1
                    yield out(name, bytes(own[:cut]))
                    del own[:cut]
                    total -= cut
                if total >= HELD:  # many languages
                    for other, rest in held.items():
                        yield out(other, bytes(rest))
                    held, total = {}, 0
            del batch
        for name, own in held.items():
            yield out(name, bytes(own))

    return docs.select("text", "lang").mapInArrow(make, "shard bigint, lang string, numbers binary, words binary")


def unpacked(numbers: bytes, words: bytes) -> tuple[np.ndarray, pa.Array]:
    """A shard's sequence and words."""
    opener = zstandard.ZstdDecompressor()
    text = opener.decompress(words).decode()
    return np.frombuffer(opener.decompress(numbers), "<i4"), pa.array(text.split("\n") if text else [], pa.large_string())


_WORDS = "shard bigint, lang string, phrase string, n bigint, number bigint"
_PACKED = "bucket bigint, shard bigint, heads binary, tails binary, counts binary"
#: Known phrases of a shard, or without a shard those of a bucket with their sums in `counts`.
_KNOWN = "shard bigint, size int, heads binary, tails binary, ids binary, counts binary"
_NAMES = "id bigint, head bigint, tail bigint, f bigint"
_SIDES = "id bigint, before bigint, behind bigint"

#: Known words that a task holds before it packs them, shard by shard.
PACKED_WORDS = 500_000


def _pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers, compressed; of ascending ones the differences between neighbours."""
    if ascending:
        values = np.diff(values, prepend=np.int64(0))
    return zstandard.ZstdCompressor(3).compress(values.astype("<i8").tobytes())


def _unpack(packed: Iterable[bytes], ascending: bool = False) -> np.ndarray:
    """The numbers of several `_pack`, one behind the other."""
    opener = zstandard.ZstdDecompressor()
    values = [np.frombuffer(opener.decompress(v), "<i8") for v in packed]
    return np.concatenate([np.zeros(0, np.int64), *(np.cumsum(v) if ascending else v for v in values)])


#: Columns of packed phrases in ascending order.
_ASCENDING = {"heads", "ids"}


def _words(held: DataFrame) -> DataFrame:
    """Every word of every shard with its count and its number in the shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                numbers, words = unpacked(row["numbers"], row["words"])
                counts = np.bincount(numbers, minlength=len(words) + 1)[1:]
                for at in range(0, len(words), 50_000):
                    some = words[at : at + 50_000].cast(pa.string())
                    shard = pa.array(np.full(len(some), row["shard"]), pa.int64())
                    lang = pa.array([row["lang"]] * len(some), pa.string())
                    number = pa.array(np.arange(at + 1, at + 1 + len(some)), pa.int64())
                    columns = [shard, lang, some, pa.array(counts[at : at + len(some)], pa.int64()), number]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "lang", "phrase", "n", "number"])

    return held.mapInArrow(count, _WORDS)


def _in_buckets(head: np.ndarray, tail: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each phrase, by the known phrases that it begins and ends with."""
    mixed = head.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ tail.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _local(known: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's known phrases of `size` words: rows of its word numbers, and ids.

    Words have their number in the shard as tail, longer phrases the ids of those of
    one word less that they begin and end with.
    """
    for k in range(1, size + 1):
        rows = known[known["size"] == k]
        tail, own = _unpack(rows["tails"]), _unpack(rows["ids"], True)
        if k == 1:
            local = tail.astype(np.int32)[:, None]
        else:
            order = np.argsort(ids)
            begin, end = (order[np.searchsorted(ids, x, sorter=order)] for x in (_unpack(rows["heads"], True), tail))
            local = np.column_stack([local[begin], local[end, -1]])
        ids = own
    return local, ids


def _of_shards(held: DataFrame, known: DataFrame, size: int, longest: int, buckets: int | None) -> DataFrame:
    """Known phrases of every shard made longer, in buckets; without those, with their extensions on either side.

    A longer phrase is named by the known phrases that it begins and ends with.
    A shard's phrases of a bucket are one row of three compressed columns.
    """

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({c.split()[0]: pd.Series(dtype=object) for c in schema.split(", ")})
        if not len(left) or not (right["size"] == size).any():
            return nothing
        numbers, _ = unpacked(left["numbers"].iloc[0], left["words"].iloc[0])
        local, ids = _local(right, size)
        if buckets is None:
            before, behind = extensions(numbers, local, longest)
            return pd.DataFrame({"id": ids, "before": before, "behind": behind})
        head, tail, n = counts_of_longer(numbers, local, longest)
        head, tail = ids[head], ids[tail]
        bucket = _in_buckets(head, tail, buckets)
        order = np.lexsort((tail, head, bucket))
        names, starts = np.unique(bucket[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        rows = {"bucket": names, "shard": np.full(len(names), left["shard"].iloc[0])}
        for name, values in (("heads", head), ("tails", tail), ("counts", n)):
            values = values[order]
            rows[name] = pd.Series([_pack(values[a:b], name in _ASCENDING) for a, b in zip(starts, ends)], dtype=object)
        return pd.DataFrame(rows)

    schema = _SIDES if buckets is None else _PACKED
    # Aliased: the phrases come from the same table.
    some = held.select(*[F.col(c).alias(c) for c in ("shard", "numbers", "words")])
    packed = known.select("shard", "size", "heads", "tails", "ids")
    return some.groupBy("shard").cogroup(packed.groupBy("shard")).applyInPandas(work, schema)


def _summed(packed: DataFrame, least: int, size: int, to_shards: bool) -> DataFrame:
    """Phrases with `least` occurrences over all shards, packed: a row for each bucket, and one for each of its shards.

    A bucket's row has their sums; those of shards, left out without `to_shards`,
    have what occurs there.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        head, tail, n = (_unpack(rows[c], c in _ASCENDING) for c in ("heads", "tails", "counts"))
        sizes = [zstandard.frame_content_size(v) // 8 for v in rows["counts"]]
        shard = np.repeat(rows["shard"].to_numpy(), sizes)
        order = np.lexsort((tail, head))
        head, tail, n, shard = head[order], tail[order], n[order], shard[order]
        new = np.concatenate([[True], (np.diff(head) != 0) | (np.diff(tail) != 0)])
        first = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        f = np.add.reduceat(n, first)
        base = int(rows["bucket"].iloc[0]) * (1 << 31)
        frequent = np.flatnonzero(f >= least)
        at = first[frequent]
        out = [(None, size, _pack(head[at], True), _pack(tail[at]), _pack(base + frequent, True), _pack(f[frequent]))] if len(at) else []
        if to_shards:
            kept = np.flatnonzero(f[which] >= least)
            kept = kept[np.argsort(shard[kept], kind="stable")]
            names, starts = np.unique(shard[kept], return_index=True)
            for name, a, b in zip(names.tolist(), starts, np.append(starts[1:], len(kept))):
                some = kept[a:b]
                out.append((name, size, _pack(head[some], True), _pack(tail[some]), _pack(base + which[some], True), None))
        columns = [c.split()[0] for c in _KNOWN.split(", ")]
        return pd.DataFrame(out, columns=columns, dtype=object).astype({"shard": "Int64"})

    return packed.groupBy("bucket").applyInPandas(work, _KNOWN)


def _names(known: DataFrame) -> DataFrame:
    """`id, head, tail, f` of the phrases that `_summed` has packed, one row each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = [pa.array(_unpack([row[c]], c in _ASCENDING), pa.int64()) for c in ("ids", "heads", "tails", "counts")]
                yield pa.RecordBatch.from_arrays(columns, ["id", "head", "tail", "f"])

    return known.where("shard is null").select("heads", "tails", "ids", "counts").mapInArrow(work, _NAMES)


def _frequent_words(level: DataFrame, least: int) -> DataFrame:
    """Rows of words that are frequent over all shards, with their sum `f` and a number `id` of the word.

    One shuffle sums a word over its shards and keeps the rows that go on. The word
    itself is in the first of its rows only, and null in the others.
    """
    of_word = Window.partitionBy("lang", "phrase")
    kept = level.withColumn("f", F.sum("n").over(of_word)).where(F.col("f") >= least)
    kept = kept.withColumn("_row", F.monotonically_increasing_id()).withColumn("id", F.min("_row").over(of_word))
    word = F.when(F.col("_row") == F.col("id"), F.col("phrase"))
    return kept.select("shard", "number", "id", "lang", word.alias("phrase"), "f")


def _packed_words(words: DataFrame) -> DataFrame:
    """Known words, packed by shard; a shard has a row from each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            shard, number, own = (
                np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("shard", "number", "id")
            )
            order = np.argsort(shard, kind="stable")
            names, starts = np.unique(shard[order], return_index=True)
            parts = [order[a:b] for a, b in zip(starts, np.append(starts[1:], len(order)))]
            columns = (
                names, [1] * len(names), [None] * len(names), [_pack(number[p]) for p in parts],
                [_pack(own[p], True) for p in parts], [None] * len(names),
            )
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED_WORDS:
                yield packed()
                held = []
        if any(b.num_rows for b in held):
            yield packed()

    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _KNOWN.split(", ")])
    return words.select("shard", "number", "id").mapInArrow(work, _KNOWN)


def phrase_counts(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, sides: bool = False
) -> tuple[DataFrame, DataFrame]:
    """`lang, phrase, words, f` of words and phrases with at least `least` occurrences, and `lang, n`.

    `n` counts all words of a language. With `sides`, also the occurrences that
    have a word `before` and `behind` in their piece.
    """
    held = stored(shards(docs), "shards")
    level = _words(held)
    totals = stored(level.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    buckets = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    words = stored(_frequent_words(level, least), "words")
    names = words.where("phrase is not null").select("id", "lang", "phrase", "f")
    known = stored(_packed_words(words), "known-words")
    out = None
    for size in range(1, longest + 1):
        told = names.select("id", "lang", "phrase", F.lit(size).alias("words"), "f")
        if sides:
            of_sides = _of_shards(held, known, size, longest, None).groupBy("id")
            told = told.join(of_sides.agg(F.sum("before").alias("before"), F.sum("behind").alias("behind")), "id")
        out = told.drop("id") if out is None else out.unionByName(told.drop("id"))
        if size == longest:
            break
        to_shards = sides or size + 1 < longest
        longer = stored(_summed(_of_shards(held, known, size, longest, buckets), least, size + 1, to_shards), "phrases")
        known = known.unionByName(longer.where("shard is not null"))
        heads = names.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("_begin"))
        tails = names.select(F.col("id").alias("tail"), F.substring_index("phrase", " ", -1).alias("_last"))
        named = _names(longer).join(heads, "head").join(tails, "tail")
        names = stored(named.select("id", "lang", F.concat_ws(" ", "_begin", "_last").alias("phrase"), "f"), "phrase-names")
    return stored(out, "phrase-counts"), totals


def _part(first: str, length: str) -> F.Column:
    words = F.split("phrase", " ", -1)
    return F.array_join(F.slice(words, F.expr(first), F.expr(length)), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: the best phrases of 2 to `longest` words of each language.

    Words are runs between blanks and tabs, A-Z lower-cased, in pieces between
    `. , ; : ! ?` and line ends (newline to carriage return); a phrase lies in one
    piece. `a` is its count, `l` and `r` those of the parts of its lowest-scoring
    cut (the first of equal ones), the score floor(1,000,000 a² / (l r)) in
    decimals. A phrase within a longer candidate that has `inside` per cent of its
    occurrences or more is left out. Ties are ranked by `a`, then by phrase.

    A null lang counts as `und`; null and empty texts have no words, repeated rows
    count each, very long texts go over several shards. An empty table gives no
    rows; other columns don't matter.
    """
    counts, totals = phrase_counts(docs.select("text", "lang"), longest, least)
    counts = counts.select("lang", "phrase", "words", F.col("f").alias("a"))
    candidates = counts.where("words > 1")
    # Where each shorter phrase of two words at least lies in a longer one.
    spans = F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> struct(s, m))))"
    )
    within = candidates.where("words > 2").select("lang", "phrase", "a", F.explode(spans).alias("part"))
    within = within.select("lang", _part("part.s", "part.m").alias("phrase"), "a")
    most = within.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(most, ["lang", "phrase"], "left").where(
        f"longer is null or 100 * longer < {inside} * a"
    )
    cut = kept.select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    parts = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("of_part"))
    cut = (
        cut.withColumn("part", _part("1", "k")).join(parts, ["lang", "part"]).withColumnRenamed("of_part", "l").drop("part")
        .withColumn("part", _part("k + 1", "words - k")).join(parts, ["lang", "part"]).withColumnRenamed("of_part", "r").drop("part")
    )
    wide = "cast({} as decimal(15, 0))"
    score = F.expr(f"cast(1000000 as decimal(7, 0)) * {wide.format('a')} * {wide.format('a')} div ({wide.format('l')} * {wide.format('r')})")
    best = (
        cut.withColumn("score", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
