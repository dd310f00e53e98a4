"""Per-domain history: upsert, lookup, pool edits, deletion."""

from __future__ import annotations

import sys
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copyloom import schemas
from copyloom.functions import keywords as kw
from copyloom.functions import text as tx
from copyloom.functions import urls
from copyloom.plans.skew import numbered
from copyloom.plans.workdir import new_path

#: Places of a pool that go, places that get another word, and those words.
Script = tuple[np.ndarray, np.ndarray, list[str]]

FILLED = ("brand_name", "target_market", "competitor_urls", "brand_info")


def parse_history(text: Column) -> Column:
    """Stored history text → array of records; damaged or missing text is an empty list."""
    kind = T.ArrayType(schemas.HISTORY_RECORD)
    return F.coalesce(F.from_json(text, kind), F.array().cast(kind))


def record_of(forms: DataFrame, saved_at: str = "saved_at") -> DataFrame:
    """Filled form with its pool → history record; rows without a domain are left out."""
    return forms.select(
        urls.domain(F.col("website_url")).alias("domain"),
        "brand_name",
        "website_url",
        "target_market",
        kw.pool(F.col("keywords_pool")).alias("keywords_pool"),
        F.array_join("competitor_urls", "\n").alias("competitor_urls"),
        "brand_info",
        tx.utc_day(F.col(saved_at)).alias("last_updated"),
        "version",
    ).where(F.col("domain") != "")


def latest_records(records: DataFrame, key: str = "domain", version: str = "version") -> DataFrame:
    """Last record per key.

    The winner is found by its key and version alone, which hash aggregation
    holds and reduces before the shuffle; whole records are joined once.
    `version` must be unique per key.
    """
    last = records.groupBy(F.col(key).alias("_key")).agg(F.max(version).alias("_last"))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(version).eqNullSafe(F.col("_last"))
    return records.join(last, same, "left_semi")


def upsert(history: DataFrame, records: DataFrame) -> DataFrame:
    """History with new records put in; a known domain is replaced in place.

    `first_saved` is the version that put the domain into the list; the list
    runs from the newest domain to the oldest: order by it, descending.
    """
    both = history.unionByName(records.withColumn("first_saved", F.col("version")))
    last = both.groupBy(F.col("domain").alias("_key")).agg(
        F.max("version").alias("_last"), F.min("first_saved").alias("_first")
    )
    same = F.col("domain").eqNullSafe(F.col("_key")) & (F.col("version") == F.col("_last"))
    others = [c for c in both.columns if c not in ("domain", "first_saved")]
    return both.join(last, same).select("domain", *others, F.col("_first").alias("first_saved"))


def fill_from_history(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Form fields with stored values where those are not empty, and the stored pool.

    Address, topic and keywords of the collection are never replaced; the pool
    always is, and is empty where the domain has no record. `requests` holds
    `domain` and competitor addresses as newline text, as the form does. A
    domain with very many requests is split by adaptive execution.
    """
    stored = history.select(
        "domain",
        *[F.col(c).alias(f"_{c}") for c in FILLED],
        kw.pool(F.col("keywords_pool")).alias("_pool"),
    )
    joined = requests.join(stored, "domain", "left")
    kept = [c for c in requests.columns if c not in FILLED and c != "keywords_pool"]
    return joined.select(
        *kept,
        *[tx.or_default(F.col(f"_{c}"), F.col(c)).alias(c) for c in FILLED],
        kw.pool(F.col("_pool")).alias("keywords_pool"),
        F.col("_pool").isNotNull().alias("matched"),
    )


#: Edits that are folded at a time, and scripts that one task joins.
EDIT_BLOCK = 1024
JOINED = 16

#: Pools that get their scripts at a time.
POOLS = 256
#: Entries of scripts that leave a task together.
_HELD = 50_000

_SCRIPT = "domain string, block bigint, size bigint, edge boolean, gone array<bigint>, places array<bigint>, words array<string>"
_ARROW_SCRIPT = pa.schema(
    [("domain", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("edge", pa.bool_())]
    + [("gone", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("words", pa.list_(pa.string()))]
)


def script_of(edits: Iterable[tuple[int, str, str | None]], size: int) -> Script:
    """Edits `pos, op, value`, one after the other, as one script for a pool of at most `size` words.

    A script says which places of the pool go and which get another word, all as
    they are before the first edit. Words behind the pool's end can't come to
    stand before it, so edits of them change nothing that is there.
    """
    gone: list[int] = []
    words: dict[int, str] = {}
    for pos, op, value in edits:
        # The place before: it has as many places that went in front of it as it moved by.
        place = pos
        while (moved := pos + bisect_right(gone, place)) != place:
            place = moved
        if place >= size:
            continue
        if op == "delete":
            insort(gone, place)
            words.pop(place, None)
        else:
            words[place] = value
    return np.array(gone, np.int64), np.array(sorted(words), np.int64), [words[p] for p in sorted(words)]


def joined_scripts(first: Script, second: Script, size: int) -> Script:
    """One script that does what the first and then the second does; joining is associative."""
    gone, places, words = first
    shift = gone - np.arange(len(gone))

    def before(at: np.ndarray) -> np.ndarray:
        return at + np.searchsorted(shift, at, side="right")

    more, again = before(second[0]), before(second[1])
    gone = np.union1d(gone, more[more < size])
    changed = dict(zip(places.tolist(), words)) | {p: w for p, w in zip(again.tolist(), second[2]) if p < size}
    for place in more.tolist():
        changed.pop(place, None)
    left = sorted(changed)
    return gone, np.array(left, np.int64), [changed[p] for p in left]


def folded_runs(batches: Iterable[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """Sorted edits `domain, size, pos, op, value` of one partition → a script per domain.

    Blocks of `EDIT_BLOCK` edits are folded, and their scripts joined two of a
    kind at a time, so that no more than a few scripts of one domain are held.
    `edge` marks the first and last domain, which other partitions may have too.
    """
    made: list[tuple] = []
    held = 0
    domain, size, first = None, 0, True
    edits: list[tuple[int, str, str | None]] = []
    parts: list[tuple[int, Script]] = []

    def block_done() -> None:
        parts.append((1, script_of(edits, size)))
        edits.clear()
        while len(parts) > 1 and parts[-2][0] == parts[-1][0]:
            (n, script), (more, before) = parts.pop(), parts.pop()
            parts.append((more + n, joined_scripts(before, script, size)))

    def run_done(edge: bool) -> int:
        if edits or not parts:
            block_done()
        whole = parts.pop()[1]
        while parts:
            whole = joined_scripts(parts.pop()[1], whole, size)
        made.append((domain, part, size, edge, *whole))
        return len(whole[0]) + len(whole[1]) + 1

    def rows() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*made), _ARROW_SCRIPT)]
        made.clear()
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW_SCRIPT)

    for batch in batches:
        for at in range(0, batch.num_rows, EDIT_BLOCK):
            columns = batch.slice(at, EDIT_BLOCK)
            for name, n, *edit in zip(*(columns.column(c).to_pylist() for c in ("domain", "size", "pos", "op", "value"))):
                if name != domain:
                    if domain is not None:
                        held += run_done(first)
                        first = False
                        if held >= _HELD:
                            yield rows()
                            held = 0
                    domain, size = name, n
                elif len(edits) == EDIT_BLOCK:
                    block_done()
                edits.append(edit)
    if domain is not None:
        run_done(True)
        yield rows()


def edit_scripts(history: DataFrame, edits: DataFrame) -> DataFrame:
    """`domain, gone, places, words`: all edits of a domain with a record as one script.

    The edits are sorted over range partitions, which cut a domain of very many
    into pieces, and each partition is folded as it is read. Only the domains at
    the ends of a partition can have further pieces; their scripts are joined
    `JOINED` at a time until one is left. A script has no more entries than its
    pool has words, so no task holds the edits of a domain together, however
    many there are.
    """
    known = history.select("domain", F.size(kw.pool(F.col("keywords_pool"))).cast("bigint").alias("size"))
    typed = tx.strip(F.coalesce("value", F.lit("")))
    order = ["domain", "edit_no", "pos", "op", "value"]
    sorted_edits = (
        edits.where((F.col("pos") >= 0) & F.col("op").isin("set", "delete"))
        .select("domain", "edit_no", F.col("pos").cast("bigint").alias("pos"), "op", "value")
        .join(known, "domain")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("domain", "size", "pos", "op", typed.alias("value"))
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return folded_runs(batches, TaskContext.get().partitionId())

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows, size = rows.sort_values("block"), int(rows["size"].iloc[0])
        parts = [(g, p, list(w)) for g, p, w in zip(rows["gone"], rows["places"], rows["words"])]
        whole = parts[0]
        for part in parts[1:]:
            whole = joined_scripts(whole, part, size)
        made = dict(zip(("gone", "places", "words"), whole))
        block = int(rows["block"].iloc[0]) // JOINED
        return pd.DataFrame({"domain": [rows["domain"].iloc[0]], "block": [block], "size": [size], "edge": [True], **{c: [v] for c, v in made.items()}})

    folded = _kept(sorted_edits.mapInArrow(fold, _SCRIPT), "edit-scripts")
    pieces = folded.where("edge")
    last = pieces.agg(F.max("block")).first()[0] or 0
    while last:
        group = F.floor(F.col("block") / JOINED)
        pieces = _kept(pieces.groupBy("domain", group.alias("_group")).applyInPandas(join, _SCRIPT), "edit-scripts")
        last //= JOINED
    return folded.where("not edge").unionByName(pieces).select("domain", "gone", "places", "words")


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def edited(pools: pa.Array, gone: pa.Array, places: pa.Array, words: pa.Array) -> pa.Array:
    """Pools under their scripts, a few at a time, without an object for each word; null stays null."""
    done = [pa.array([], pa.list_(pa.string()))]
    for at in range(0, len(pools), POOLS):
        some, less, where, new = (c.slice(at, POOLS) for c in (pools, gone, places, words))
        sizes = pc.list_value_length(some).fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

        def of_all(lists: pa.Array, starts: np.ndarray = offsets[:-1]) -> np.ndarray:
            n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            return np.repeat(starts, n) + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

        old, added = some.flatten(), new.flatten()
        index = np.arange(len(old))
        index[of_all(where)] = len(old) + np.arange(len(added))
        stays = np.ones(len(old), bool)
        stays[of_all(less)] = False
        kept = np.concatenate([[0], np.cumsum(stays)])[offsets]
        values = pa.concat_arrays([old, added]).take(pa.array(index[stays]))
        done.append(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), values, mask=some.is_null()))
    return pa.concat_arrays(done)


def edit_pools(history: DataFrame, edits: DataFrame) -> DataFrame:
    """Pools after a batch of edits, applied one after the other.

    `edits`: `domain, edit_no, pos, op ('set' or 'delete'), value`. Edits of a
    domain run by ascending `edit_no`; `pos` is the 0-based place in the pool
    as the edits before have left it, so places move up behind a deleted word.
    Places outside the pool, and edits without a place, do nothing. A pool is
    one row; its edits meet there as one script.
    """
    scripts = edit_scripts(history, edits)

    applied = F.arrow_udf(edited, "array<string>")
    joined = history.join(
        scripts.select("domain", F.col("gone").alias("_gone"), F.col("places").alias("_places"), F.col("words").alias("_words")),
        "domain",
        "left",
    )
    pool = kw.pool(F.col("keywords_pool"))
    changed = applied(F.when(F.col("_gone").isNotNull(), pool), "_gone", "_places", "_words")
    return joined.withColumn("keywords_pool", F.coalesce(changed, pool)).select(*history.columns)


def delete_records(history: DataFrame, domains: DataFrame) -> DataFrame:
    return history.join(domains.select("domain"), "domain", "left_anti")


def delete_positions(history: DataFrame, positions: DataFrame) -> DataFrame:
    """History without the records at the given 0-based places of the list (`pos`), newest first.

    Only domains and their order are numbered; the records are joined by domain.
    """
    newest = history.select("domain", (-F.col("first_saved")).alias("_newest"))
    placed = numbered(newest, [], ["_newest", "domain"], "_place")
    gone = placed.join(positions.select((F.col("pos") + 1).alias("_place")), "_place", "left_semi")
    return history.join(gone.select("domain"), "domain", "left_anti")


# Ship the jobs with their code, so that executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
