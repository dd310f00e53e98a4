"""Spelling variants: words one edit apart, by an index of variable-length grams.

Every word, with a mark at either end, is cut into one gram per place: the
shortest run from there that is not frequent, of 2 to `LONGEST` characters. The
frequent grams are the dictionary, counted level by level over all words, with
longer ones only behind frequent shorter ones.

One edit changes the grams whose characters it touches. A word's largest number
of grams over one place bounds how many that can be, so each set of one gram more
holds a gram that both words of a near pair have. Of the rarest such set, each
gram lies before the edit, and then all that stands before its end is equal, or
behind it, and then all from its start on is. Words are listed under both; words
that meet in a list are compared.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import ship, stored

#: Code points that a word has at least, and its occurrences.
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form has at least so many times the occurrences of the word.
TIMES = 10
#: Characters of the longest grams, marks at the ends included. A word has one gram more
#: than code points and an edit changes at most this many, so with less than
#: `LEAST_LENGTH + 1` two near words always share one.
LONGEST = 5
#: Words of a gram from which on it is frequent, and the dictionary's bound on the grams
#: of one length; a larger corpus of words raises the former to keep the latter.
FREQUENT = 32
DICTIONARY = 200_000
#: Every so many-th run, by hash, loses a code point in `thinned`.
THIN = 31

_START, _END = "\x02", "\x03"
#: Bytes of text that are counted at a time.
_SLICE = 8_000_000


def thinned(run: str, doc_id: int | None) -> str:
    """The run as it counts: without one of its code points if the hash of document and run says so.

    Runs of rows without an id stay as they are.
    """
    if doc_id is None:
        return run
    h = crc32(f"{doc_id}:{run}".encode())
    if h % THIN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words_of(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """`doc_id, text` → `word, n`: thinned lower-cased letter runs, long and frequent enough."""
    ship(docs.sparkSession)
    # Thinning takes one code point, so shorter runs never count.
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            made = [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(made, ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                data = (text.as_py() or "").encode().lower()  # A-Z only
                number = doc_id.as_py()
                for run, n in Counter(runs.findall(data.decode())).items():
                    word = thinned(run, number)
                    if len(word) >= least_length:
                        total[word] += n
                size += len(data)
                if size >= _SLICE:
                    yield out()
                    total.clear()
                    size = 0
            del batch
        if total:
            yield out()

    counted = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def dictionary(words: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT, bound: int = DICTIONARY) -> dict[str, int]:
    """Frequent grams with their counts over all `word`s; at most `bound` of each length.

    A gram that occurs over `places / bound` times can't be one of more than `bound`.
    """
    ship(words.sparkSession)
    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    limit = max(frequent, places // bound)
    found: dict[str, int] = {}
    level: set[str] = set()
    for length in range(2, longest + 1):
        before = frozenset(level)

        def count(
            batches: Iterator[pa.RecordBatch], length: int = length, before: frozenset[str] = before
        ) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total: Counter[str] = Counter()
                for word in batch.column("word").to_pylist():
                    marked = f"{_START}{word}{_END}"
                    places = range(len(marked) - length + 1)
                    if length == 2:
                        total.update(marked[i : i + 2] for i in places)
                    else:
                        total.update(marked[i : i + length] for i in places if marked[i : i + length - 1] in before)
                made = [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(made, ["gram", "n"])

        counted = words.select("word").mapInArrow(count, "gram string, n bigint")
        rows = counted.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > limit).collect()
        found |= {r.gram: r.n for r in rows}
        level = {r.gram for r in rows}
        if not level:
            break
    return found


def grams(word: str, frequent: dict[str, int], longest: int = LONGEST) -> list[tuple[int, str]]:
    """Place and text of each gram of a marked word."""
    marked = f"{_START}{word}{_END}"
    size = len(marked)
    found = []
    for at in range(size - 1):
        end = at + 2
        while end < size and end - at < longest and marked[at:end] in frequent:
            end += 1
        found.append((at, marked[at:end]))
    return found


def affected(cut: list[tuple[int, str]], length: int) -> int:
    """Grams of a word of this length that one edit can change at most."""
    over = [0] * (length + 3)
    for at, gram in cut:
        over[at] += 1
        over[at + len(gram)] -= 1
    most = total = over[0]
    for place in range(1, length + 1):  # the marks themselves are not edited
        total += over[place]
        most = total if place == 1 else max(most, total)
    return most


def listed(words: DataFrame, frequent: dict[str, int], longest: int = LONGEST) -> DataFrame:
    """`word, n` → `context, word, n`: the word under each list that it has to be looked up in."""
    ship(words.sparkSession)
    shared = words.sparkSession.sparkContext.broadcast(frequent)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 5000):
                batch = whole.slice(start, 5000)
                contexts: list[str] = []
                rows: list[int] = []
                for row, word in enumerate(batch.column("word").to_pylist()):
                    marked = f"{_START}{word}{_END}"
                    cut = grams(word, known, longest)
                    # Rarest first; the same order for all words, and by place among equal grams.
                    first = sorted(cut, key=lambda g: (known.get(g[1], 0), g[1], g[0]))[: affected(cut, len(word)) + 1]
                    own = {marked[: at + len(gram)] for at, gram in first} | {marked[at:] for at, gram in first}
                    contexts += own
                    rows += [row] * len(own)
                at = pa.array(rows, pa.int32())
                made = [pa.array(contexts, pa.string()), batch.column("word").take(at), batch.column("n").take(at)]
                yield pa.RecordBatch.from_arrays(made, ["context", "word", "n"])

    placed = words.select("word", "n").mapInArrow(place, "context string, word string, n bigint")
    # Start and end contexts differ by their marks; equal hashes only cost a comparison.
    return placed.select(F.xxhash64("context").alias("context"), "word", "n")


def near_words(words: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT) -> DataFrame:
    """`word, n` → all pairs `word, n, other, other_n` one edit apart, each way round.

    Words have at least `longest` code points. A list that many words stand in
    is one key of a sort-merge join, which adaptive execution splits.
    """
    if longest < 2:
        raise ValueError("grams have two characters at least")
    index = stored(listed(words, dictionary(words, longest, frequent), longest), "gram-lists")
    a = index.select("context", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = index.select("context", F.col("word").alias("b"), F.col("n").alias("b_n"))
    near = (
        F.col("a") < F.col("b")
    ) & F.abs(F.length("a") - F.length("b")).between(0, 1) & (F.levenshtein("a", "b", 1) == 1)
    met = a.join(b, (a["context"] == b["context"]) & near)
    pairs = stored(met.select("a", "a_n", "b", "b_n").distinct(), "near-words")
    way = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    back = pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    return way.unionByName(back)


def roots(forms: DataFrame) -> DataFrame:
    """`word, form` → `word, root`: the last word that forms lead to.

    Each step doubles the way already gone; as a form is `TIMES` as frequent, the
    number of steps grows with the logarithm of the logarithm of the counts.
    """
    found = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("_ahead"))
        moved = found.join(ahead, "root", "left").select(
            "word", F.coalesce("_ahead", "root").alias("root"), F.col("_ahead").isNotNull().alias("_moved")
        )
        moved = stored(moved, "roots")
        found = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return found


def variants(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES
) -> DataFrame:
    """`word, form, root, n, n_near, form_n`: one row per word of the texts of `docs` (`doc_id, text`).

    Words are the distinct thinned runs of `A-Z a-z À-ÿ`, A-Z lower-cased, that
    are long and frequent enough. `form` is the near word of largest n (of equal
    ones the smallest), if that is at least `times` the word's own, else null.
    Null and empty texts have no words; rows without an id count with their runs
    unchanged, repeated rows count twice, and a very long text is one row of a task.
    An empty table gives no rows; other columns don't matter.
    """
    if least_length <= LONGEST - 1:
        raise ValueError("words have to be longer than grams for two near ones to share one")
    words = stored(words_of(docs, least_length, least_count), "words")
    pairs = near_words(words)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    near = pairs.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= times * F.col("n")
    near = stored(
        near.select(
            "word",
            "n_near",
            F.when(is_form, F.col("best.word")).alias("form"),
            F.when(is_form, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(near.where("form is not null"))
    return (
        words.join(near, "word", "left")
        .join(last, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            "form_n",
        )
    )
