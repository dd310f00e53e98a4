"""Near duplicates by an LSH forest, confirmed on the full shingle sets.

Texts with the same words in the same order are one class. Each class has
several sort keys, runs of its MinHash signature. In every order, neighbours
with a common prefix are candidates; how long it has to be grows with the
distance, so that sparse regions are searched at small depth and dense ones at
large depth. Candidates carry a bit sketch that rules out most unlike pairs
where they are found; the others are compared on whole sets.

The orders are searched twice. The first search takes the nearest plausible
neighbours of each class, of which the best few are compared. The second one has
no distance: all classes that share the first values of a key in any order meet
in blocks, where all plausible pairs that are not connected yet are compared on
whole sets. A block gives out links that join two parts, fewer than its classes;
pairs inside a component can't change it any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from copyloom.llm.common import give_back, ship, stored
from copyloom.llm.graph import components
from copyloom.llm.shingles import MinHash, sequence_digest, shingle_hashes

WIDTH = 5  # words in a shingle
SHARE = 75  # per cent of the union that two sets have to share
TREES = 24
DEPTH = 8  # values in a sort key

#: (neighbours up to this distance, values that their keys have to share), for the first search.
NEAR = ((4, 2), (16, 3))
#: Values of a key that classes have to share in the second search, at any distance,
#: and the classes in a block, and the bytes of their texts, about. One task compares two blocks.
SHARED = 2
BLOCK = 2048
BLOCK_BYTES = 8_000_000
#: Plausible neighbours of a class in each order after which the first search moves on.
ENOUGH = 2

#: Bits of each signature value in the sketches of the first search and the second.
NEAR_BITS, FAR_BITS = 2, 4


def plausible(bits: int) -> float:
    """The similarity that sketches have to point to: five standard deviations below the one asked for.

    Unequal values agree in all their bits by chance one time in 2^bits.
    """
    distinct = 1 - 0.5**bits
    agree = 1 - distinct * (1 - SHARE / 100)
    return SHARE / 100 - 5 * (agree * (1 - agree) / (TREES * DEPTH)) ** 0.5 / distinct


#: Candidates of each class that are compared first.
FIRST = 3
#: Ids that may be broadcast (8 bytes each).
BROADCAST_ROWS = 1_000_000


def sketches(docs: DataFrame) -> DataFrame:
    """`doc_id, n_shingles, n_bytes, words` (digest of the word sequence), `signature`, `bits`.

    A text without words, or null, has no shingles, and null in the last three.
    """
    ship(docs.sparkSession)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("n_bytes", pa.int64())]
        + [("words", pa.binary()), ("signature", pa.binary()), ("bits", pa.binary())]
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = MinHash(TREES * DEPTH)
        for batch in batches:
            texts, rows = batch.column("text"), []
            for i, hashes in enumerate(shingle_hashes(texts, WIDTH)):
                distinct = np.unique(hashes)
                if not len(distinct):
                    rows.append((0, 0, None, None, None))
                    continue
                least = minima(distinct)
                shifts = ((7, 13), (8, 17), (5, 11), (9, 15))
                odd = np.concatenate([_parity(least >> np.uint32(i), *x) for i, x in enumerate(shifts)])
                text = texts[i].as_py()
                rows.append(
                    (
                        len(distinct),
                        len(text.encode()),
                        sequence_digest(text),
                        least.astype(">u4").tobytes(),
                        np.packbits(odd).tobytes(),
                    )
                )
            columns = list(zip(*rows)) or [()] * 5
            made = [pa.array(v, f.type) for v, f in zip(columns, list(schema)[1:])]
            ids = pa.concat_arrays([batch.column("doc_id")])
            del batch, texts, rows, columns  # what comes next is read while this is handed over
            yield pa.RecordBatch.from_arrays([ids, *made], schema=schema)
            pa.default_memory_pool().release_unused()
        give_back()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        make, "doc_id bigint, n_shingles bigint, n_bytes bigint, words binary, signature binary, bits binary"
    )


def _parity(values: np.ndarray, *shifts: int) -> np.ndarray:
    out = values.copy()
    for s in shifts:
        out ^= values >> np.uint32(s)
    return (out & np.uint32(1)).astype(np.uint8)


_ROW = ["tree", "key", "bits", "size", "part_of", "id"]


class _Order:
    """Consecutive rows of the sort orders as arrays."""

    def __init__(self, rows: pd.DataFrame, bits: int) -> None:
        self.tree, self.size, self.part_of, self.ids = (
            rows[c].to_numpy() for c in ("tree", "size", "part_of", "id")
        )
        self.keys = np.frombuffer(b"".join(rows["key"]), ">u4").reshape(len(rows), DEPTH)
        self.bits = np.frombuffer(b"".join(rows["bits"]), np.uint64).reshape(len(rows), bits, TREES * DEPTH // 64)
        self.least, self.distinct = plausible(bits), 1 - 0.5**bits

    def pairs(self, left: int, reach: tuple, enough: int | None) -> pd.DataFrame:
        """Candidates `a, b, similar` of the first `left` rows with rows behind them."""
        here = np.arange(left)
        taken = np.zeros(left, np.int64)
        found = []
        depths = [need for (upto, need), low in zip(reach, (0, *(r[0] for r in reach))) for _ in range(upto - low)]
        for distance, need in enumerate(depths, 1):
            here = here[here + distance < len(self.ids)]
            there = here + distance
            same = (self.tree[here] == self.tree[there]) & (
                self.keys[here, :need] == self.keys[there, :need]
            ).all(axis=1)
            here, there = here[same], there[same]
            if not len(here):
                break
            either = np.bitwise_or.reduce(self.bits[here] ^ self.bits[there], axis=1)
            unlike = np.bitwise_count(either).sum(axis=1, dtype=np.int64)
            similar = 1 - unlike / (self.distinct * TREES * DEPTH)
            a, b = self.size[here], self.size[there]
            fits = (similar >= self.least) & (100 * np.minimum(a, b) >= SHARE * np.maximum(a, b))
            fits &= self.part_of[here] != self.part_of[there]
            found.append((self.ids[here[fits]], self.ids[there[fits]], similar[fits]))
            if enough is not None:
                taken[here[fits]] += 1
                here = here[taken[here] < enough]
        a, b, similar = (np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2 + (np.empty(0),), *found))
        made = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similar": similar})
        return made.drop_duplicates(["a", "b"])


def candidates(classes: DataFrame, reach: tuple, bits: int, enough: int | None = None) -> DataFrame:
    """`id, part_of, n_shingles, signature, bits` → plausible pairs `a, b, similar`, with a < b.

    Pairs within one `part_of` are left out. The orders are range partitioned, so
    that a dense region spreads over tasks; each task also hands over its first
    and last rows, and neighbours across a boundary are found among those.
    """
    ship(classes.sparkSession)
    furthest = reach[-1][0]
    key = F.substring(F.col("signature"), F.col("tree") * (DEPTH * 4) + 1, F.lit(DEPTH * 4))
    rows = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select(
        "tree", key.alias("key"), F.substring("bits", 1, bits * TREES * DEPTH // 8).alias("bits"), F.col("n_shingles").alias("size"), "part_of", "id"
    )
    partitions = max(1, classes.count() * TREES // 100_000)
    ordered = rows.repartitionByRange(partitions, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    kinds = {"tree": "int", "key": "binary", "bits": "binary", "size": "bigint", "part_of": "bigint", "id": "bigint"}

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        columns = ["a", "b", "similar", "part", "at_end", *_ROW]
        heads, pending = 0, []

        def out(pairs: pd.DataFrame) -> pd.DataFrame:
            return pairs.assign(part=None, at_end=None, **{c: None for c in _ROW})[columns]

        def edge(some: pd.DataFrame, at_end: bool) -> pd.DataFrame:
            return some.assign(a=None, b=None, similar=None, part=part, at_end=at_end)[columns]

        for frame in frames:
            if heads < furthest and len(frame):
                yield edge(frame.iloc[: furthest - heads], False)
                heads += min(len(frame), furthest - heads)
            pending.append(frame)
            if sum(map(len, pending)) < 20_000:
                continue
            held = pd.concat(pending, ignore_index=True)
            done = len(held) - furthest
            yield out(_Order(held, bits).pairs(done, reach, enough))
            pending = [held.iloc[done:]]
        if pending:
            held = pd.concat(pending, ignore_index=True)
            if len(held):
                yield out(_Order(held, bits).pairs(len(held), reach, enough))
                yield edge(held.iloc[-furthest:], True)
        give_back()

    schema = ", ".join(
        ["a bigint, b bigint, similar double, part int, at_end boolean", *(f"{c} {k}" for c, k in kinds.items())]
    )
    scanned = stored(ordered.mapInPandas(scan, schema), "neighbours")
    edges = scanned.where("part is not null")
    # One row per partition that has rows; the next one may not be the next number.
    steps = edges.select("part").distinct().withColumn("gap", F.row_number().over(Window.orderBy("part")))
    rims = edges.join(F.broadcast(steps), "part").withColumn(
        "gap", F.when(F.col("at_end"), F.col("gap")).otherwise(F.col("gap") - 1)
    )

    def stitch(rim: pd.DataFrame) -> pd.DataFrame:
        # By place, not by value: ties on the key have been told apart by id.
        rim = rim.sort_values(["part", "tree", "key", "id"])
        return _Order(rim, bits).pairs(len(rim), reach, enough)

    across = rims.groupBy("gap").applyInPandas(stitch, "a bigint, b bigint, similar double")
    return (
        scanned.where("part is null")
        .select("a", "b", "similar")
        .unionByName(across)
        .groupBy("a", "b")
        .agg(F.max("similar").alias("similar"))
    )


def region_links(classes: DataFrame, texts: DataFrame, bits: int) -> DataFrame:
    """`id, part_of, n_shingles, n_bytes, signature, bits` → links `a, b` that join unlike `part_of`, with a < b.

    Every two classes with `SHARED` equal values at the start of a key meet in the
    first order where they have them. A large region is cut into blocks by hash,
    each two of which meet in a group of their own; `texts` (`id, text`) go along.
    Pairs that aren't linked never leave a group, and of those that are, only as
    many as join its parts.
    """
    ship(classes.sparkSession)
    start = lambda tree: F.substring(F.col("signature"), tree * (DEPTH * 4) + 1, F.lit(SHARED * 4))
    starts = F.concat(*[start(F.lit(t)) for t in range(TREES)])
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    keyed = classes.select("*", tree).withColumn("start", start(F.col("tree")))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    regions = stored(
        keyed.groupBy("tree", "start")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"),
            F.min("part_of").alias("least"), F.max("part_of").alias("most"),
        )
        .where("least != most")
        .select("tree", "start", blocks.alias("blocks")),
        "regions",
    )
    small = F.broadcast(regions) if regions.count() <= BROADCAST_ROWS // 5 else regions
    places = stored(keyed.select("id", "tree", "start").join(small, ["tree", "start"]), "places")
    ids = stored(places.select("id").distinct(), "places-ids")
    texts = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "id", "left_semi")
    own = classes.select(
        "id", "part_of", F.col("n_shingles").alias("size"),
        F.substring("bits", 1, bits * TREES * DEPTH // 8).alias("bits"), starts.alias("starts"),
    )
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = (
        places.join(own, "id")
        .join(texts, "id")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .drop("blocks", "other")
    )
    least, distinct = plausible(bits), 1 - 0.5**bits

    def compare(met: pa.Table) -> pa.Table:
        # Arrow: most groups are small, and a frame of pandas takes longer to make than their pairs to compare.
        low, high, tree = (met.column(c)[0].as_py() for c in ("low", "high", "tree"))
        block, ids, size, part_of = (met.column(c).to_numpy() for c in ("block", "id", "size", "part_of"))
        if low != high:
            order = np.argsort(block, kind="stable")
            met, block, ids, size, part_of = met.take(order), block[order], ids[order], size[order], part_of[order]
        sketch = np.frombuffer(b"".join(met.column("bits").to_pylist()), np.uint64).reshape(len(ids), bits, TREES * DEPTH // 64)
        begin = np.frombuffer(b"".join(met.column("starts").to_pylist()), np.dtype((np.void, SHARED * 4))).reshape(len(ids), TREES)
        text = met.column("text")
        root = np.unique(part_of, return_inverse=True)[1]
        edge = int((block == low).sum())
        sets: dict[int, np.ndarray] = {}
        found = []

        def whole_sets(some: list[int]) -> None:
            new = [i for i in some if i not in sets]
            if not new:
                return
            for i, hashes in zip(new, shingle_hashes(text.take(new).combine_chunks(), WIDTH)):
                sets[i] = np.unique(hashes)

        for i in range(edge):
            there = np.arange(i + 1 if low == high else edge, len(ids))
            there = there[(root[there] != root[i]) & (100 * np.minimum(size[there], size[i]) >= SHARE * np.maximum(size[there], size[i]))]
            if not len(there):
                continue
            unlike = np.bitwise_count(np.bitwise_or.reduce(sketch[there] ^ sketch[i], axis=1)).sum(axis=1, dtype=np.int64)
            near = 1 - unlike / (distinct * TREES * DEPTH) >= least
            there, unlike = there[near], unlike[near]
            if tree:
                apart = ~(begin[there, :tree] == begin[i, :tree]).any(axis=1)
                there, unlike = there[apart], unlike[apart]
            for j in there[np.argsort(unlike, kind="stable")].tolist():
                if root[j] == root[i]:
                    continue
                whole_sets([i, j])
                x, y = sets[i], sets[j]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared and 100 * shared >= SHARE * (len(x) + len(y) - shared):
                    root[root == root[j]] = root[i]
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        made = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": made[:, 0], "b": made[:, 1]})

    return rows.groupBy("tree", "start", "low", "high").applyInArrow(compare, "a bigint, b bigint")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs `a, b` whose whole sets are similar enough; `texts`: `id, text`."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = shingle_hashes(batch.column("first"), WIDTH)
            seconds = shingle_hashes(batch.column("second"), WIDTH)
            linked = []
            for x, y in zip(firsts, seconds):
                x, y = np.unique(x), np.unique(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= SHARE * (len(x) + len(y) - shared) and shared > 0)
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
            pa.default_memory_pool().release_unused()
        give_back()

    second = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("second")), "b")
    both = second.join(texts.select(F.col("id").alias("a"), F.col("text").alias("first")), "a")
    return both.select("a", "b", "first", "second").mapInArrow(compare, "a bigint, b bigint")


def near_dedup(docs: DataFrame) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept`, one row per row.

    Texts are linked if their sets of five-word shingles share at least 75 of
    100 of their union. Null and texts without words are linked with nothing
    and kept; ids have to be unique for `kept` to name one row; a null doc_id is
    kept and linked with nothing. An empty table gives no rows; other columns
    don't matter.
    """
    docs = docs.select("doc_id", "text")
    rows = stored(sketches(docs), "sketches")
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    classes = stored(
        usable.groupBy("words").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes"
    )
    # Every word sequence once, by its smallest id.
    heads = usable.join(classes.select("words", "id"), "words").where("doc_id = id")
    heads = stored(heads.select("id", "n_shingles", "n_bytes", "signature", "bits").dropDuplicates(["id"]), "heads")
    pairs = stored(candidates(heads.withColumn("part_of", F.col("id")), NEAR, NEAR_BITS, ENOUGH), "candidates")
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "similar").unionByName(
        pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "similar")
    )
    involved = stored(both.select("id").distinct(), "involved")
    few = involved.count() <= BROADCAST_ROWS
    texts = stored(
        docs.withColumnRenamed("doc_id", "id").join(F.broadcast(involved) if few else involved, "id", "left_semi"),
        "candidate-texts",
    )
    best = F.slice(F.sort_array(F.collect_list(F.struct("similar", "other")), asc=False), 1, FIRST)
    first = (
        both.groupBy("id")
        .agg(best.alias("best"))
        .select("id", F.explode("best.other").alias("other"))
        .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        .distinct()
    )
    links = stored(confirmed(first, texts), "links")
    part = stored(components(links), "components")

    searched = (
        heads.join(part, "id", "left")
        .withColumn("part_of", F.coalesce("component_id", "id"))
        .drop("component_id")
    )
    more = stored(region_links(stored(searched, "searched"), docs.withColumnRenamed("doc_id", "id"), FAR_BITS), "more-links")
    whole = stored(components(links.unionByName(more)), "components")
    by_words = classes.select("words", F.col("id").alias("head"))
    out = rows.select("doc_id", "n_shingles", "words").join(by_words, "words", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(
        F.coalesce("component_id", "head", "doc_id")
    )
    return (
        out.join(whole.withColumnRenamed("id", "head"), "head", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
