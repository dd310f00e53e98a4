"""Best-fit packing of token sequences, with large items matched in pairs first.

Items of one length are alike, so the places are worked out on the table of
lengths, which has at most `capacity` rows however many documents there are; the
items are then numbered and take their places by number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import give_back, ship, stored
from copyloom.llm.tokens import coder, id_bytes
from copyloom.plans.skew import numbered

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(
    docs: DataFrame,
    capacity: int = 4096,
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 1,
) -> DataFrame:
    """Documents → `doc_id, piece, start, length, ids_crc32`.

    A document is its ids and the end id; only longer ones are cut, into pieces
    of `capacity`, the last of which may be shorter. A null or empty text is the
    end id alone. Every row counts, repeated ones too; other columns don't matter.
    """
    ship(docs.sparkSession)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32())]
        + [(c, pa.int64()) for c in ("start", "length", "ids_crc32")]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, end, most = coder(vocabulary, True), id_bytes([end_id]), capacity * 4
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), make.each(batch.column("text"))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), most)):
                    part = ids[at : at + most]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            del batch  # the next one is read while this one's pieces are handed over
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema
                )
            pa.default_memory_pool().release_unused()
        make.rest()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Lengths with their counts → runs of places, sorted by their first number.

    Items are numbered from 0 by ascending length. A run `first, length, each,
    bin, offset` says: from number `first` on, each bin from `bin` on takes
    `each` items of this length, the first of them at `offset`.

    Items above a third of the capacity are matched greedily, the longest with
    the longest that still fits beside it, two at most to a bin. The others
    follow by descending length, each to the bin with the smallest gap that
    takes it, or else to a new bin. Bins filled alike are one entry, so the work
    depends on the number of different lengths, not on the counts.
    """
    left = {s: c for s, c in counts.items() if c}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("lengths have to be from 1 to the capacity")
    # Gap → alike bins: (number of bins, what they hold, newest first as (older, length, each)).
    gaps: dict[int, list[tuple[int, tuple | None]]] = {}
    bits = 0  # of gaps with bins

    def put(gap: int, n: int, held: tuple | None) -> None:
        nonlocal bits
        if n:
            gaps.setdefault(gap, []).append((n, held))
            bits |= 1 << gap

    large = [s for s in left if 3 * s > capacity]
    ordered = sorted(large, reverse=True)
    for s in ordered:
        n = left.pop(s, 0)
        while n:
            # The longest other large item that fits beside it; itself, if nothing longer does.
            fits = [o for o in large if o <= capacity - s and (left.get(o) or o == s and n > 1)]
            if not fits:
                put(capacity - s, n, (None, s, 1))
                break
            o = max(fits)
            if o == s:
                put(capacity - 2 * s, n // 2, (None, s, 2))
                n %= 2
            else:
                m = min(n, left[o])
                put(capacity - s - o, m, ((None, s, 1), o, 1))
                n -= m
                left[o] -= m
                if not left[o]:
                    del left[o]
        large = [o for o in large if o in left]
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            above = bits >> s
            if not above:
                each = capacity // s
                put(capacity - each * s, n // each, (None, s, each))
                put(capacity - (n % each) * s, 1 if n % each else 0, (None, s, n % each))
                break
            gap = s + (above & -above).bit_length() - 1
            bins, held = gaps[gap].pop()
            if not gaps[gap]:
                bits &= ~(1 << gap)
            each = gap // s
            full = min(bins, n // each)
            put(gap - each * s, full, (held, s, each))
            n -= full * each
            rest = bins - full
            if rest and n:
                put(gap - n * s, 1, (held, s, n))
                rest, n = rest - 1, 0
            put(gap, rest, held)
    first: dict[int, int] = {}
    total = 0
    for s in sorted(counts):
        first[s] = total
        total += counts[s]
    runs, bin_no = [], 0
    for alike in gaps.values():
        for bins, held in alike:
            inside = []
            while held:
                inside.append(held[1:])
                held = held[0]
            offset = 0
            for s, each in reversed(inside):
                runs.append((first[s], s, each, bin_no, offset))
                first[s] += bins * each
                offset += s * each
            bin_no += bins
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Pieces (with a `length` from 1 to the capacity) → the same with `sequence_id, offset`.

    Columns named `sequence_id`, `offset` or `item_no` are replaced. An empty
    table stays empty; equal lengths are told apart by doc_id and piece.
    """
    spark = pieces.sparkSession
    ship(spark)
    pieces = pieces.drop("sequence_id", "offset", "item_no")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan_bins(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, length, each, bins, offset = runs.value.T
        for batch in batches:
            number = batch.column("item_no").to_numpy() - 1
            run = np.searchsorted(first, number, side="right") - 1
            inner = number - first[run]
            batch = batch.append_column("sequence_id", pa.array(bins[run] + inner // each[run]))
            yield batch.append_column("offset", pa.array(offset[run] + inner % each[run] * length[run]))

    items = numbered(pieces, [], ["length", "doc_id", "piece"], "item_no")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    placed = items.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")
    return placed.drop("item_no")


def pack_documents(
    docs: DataFrame,
    capacity: int = 4096,
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 1,
) -> DataFrame:
    """Documents → their pieces with `sequence_id` and `offset`; texts are encoded once."""
    return pack(stored(token_pieces(docs, capacity, vocabulary, end_id), "pieces"), capacity)
