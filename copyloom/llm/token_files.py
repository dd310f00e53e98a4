"""Token-id files: each document is one zstandard frame under a shared dictionary.

A token folder holds two tables, so that any store that Spark reaches can keep it:

- `dictionary`: one row, `dict_hash` (first 8 bytes of its SHA-256, as hex) and
  `content`, trained on serialized id arrays; empty where there was too little to
  train on.
- `shards`: `part, shard, first_doc, last_doc, local_start, n_tokens, width,
  dict_hash, doc_ids, counts, offsets, frames`. `frames` holds the documents'
  frames one behind the other, `offsets` where each starts (and the last ends),
  `counts` the ids of each; ids are unsigned little-endian of `width` bytes.
  Parts and shards are in ascending order of doc_id, and `local_start` counts the
  ids before a shard in its part.

A single document is found by `first_doc`/`last_doc`, which readers can skip by,
and only its own frame is decompressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from copyloom.llm.common import ship
from copyloom.llm.tokens import coder, id_bytes

_SHARDS = (
    "part int, shard int, first_doc bigint, last_doc bigint, local_start bigint, n_tokens bigint,"
    " width int, dict_hash string, doc_ids array<bigint>, counts array<bigint>,"
    " offsets array<bigint>, frames binary"
)


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(
    docs: DataFrame,
    vocabulary: str,
    width: int,
    samples: int = 1024,
    window: int = 4096,
    size: int = 65_536,
) -> DataFrame:
    """One row `dict_hash, content`, trained on windows of at most `samples` documents.

    The sample is bounded by its parameters: `samples` windows of `window`
    characters each, chosen by hash. Fewer than 64 windows give an empty dictionary.
    """
    ship(docs.sparkSession)
    place = F.pmod(
        F.xxhash64("doc_id", F.lit(7)), F.greatest(F.lit(1), F.length("text") - window)
    ).cast("int")
    sample = (
        docs.where(F.length("text") > 0)
        .select(
            F.xxhash64("doc_id", F.lit(11)).alias("h"),
            F.substring("text", place + 1, F.lit(window)).alias("text"),
        )
        .orderBy("h")
        .limit(samples)
        .select("text")
        .coalesce(1)
    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        texts = [t for b in batches for t in b.column("text").to_pylist()]
        content = b""
        if len(texts) >= 64:
            ids = coder(vocabulary, False).encode(pa.array(texts, pa.string()))
            try:
                trained = zstandard.train_dictionary(size, [_narrow(i, width) for i in ids])
                content = trained.as_bytes()
            except zstandard.ZstdError:  # too even or too short to train on
                content = b""
        name = hashlib.sha256(content).hexdigest()[:16]
        yield pa.RecordBatch.from_pydict({"dict_hash": [name], "content": [content]})

    return sample.mapInArrow(train, "dict_hash string, content binary")


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = 2,
    width: int = 2,
    shard_bytes: int = 4 << 20,
    level: int = 3,
) -> None:
    """Write the ids of every text of `docs` (`doc_id, text`) to a token folder.

    A null or empty text is the end id alone; a null doc_id sorts first; rows of
    one doc_id stay apart, in an order that their text decides; other columns
    don't matter. A text of any length is one frame, and a shard holds whole
    documents, as many as reach `shard_bytes`. An empty table gives no shards.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    train_dictionary(docs, vocabulary, width).write.parquet(f"{path}/dictionary")
    trained = spark.read.parquet(f"{path}/dictionary").first()
    content, name = bytes(trained["content"]), trained["dict_hash"]
    schema = pa.schema(
        [("part", pa.int32()), ("shard", pa.int32())]
        + [(c, pa.int64()) for c in ("first_doc", "last_doc", "local_start", "n_tokens")]
        + [("width", pa.int32()), ("dict_hash", pa.string())]
        + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "counts", "offsets")]
        + [("frames", pa.binary())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        shared = zstandard.ZstdCompressionDict(content) if content else None
        compress = zstandard.ZstdCompressor(level=level, dict_data=shared).compress
        make, end = coder(vocabulary, False), id_bytes([end_id])
        shard, before = 0, 0
        docs: list[int | None] = []
        counts: list[int] = []
        frames: list[bytes] = []
        filled = 0

        def closed() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            row = (
                part, shard, docs[0], docs[-1], before, sum(counts), width, name,
                docs, counts, offsets, b"".join(frames),
            )
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema
            )

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), make.each(batch.column("text"))):
                docs.append(doc_id)
                counts.append(len(ids) // 4 + 1)
                frames.append(compress(_narrow(ids + end, width)))
                filled += len(frames[-1])
                if filled >= shard_bytes:
                    yield closed()
                    shard, before, filled = shard + 1, before + sum(counts), 0
                    docs, counts, frames = [], [], []
        if docs:
            yield closed()

    order = ["doc_id", F.xxhash64("text")]
    placed = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.mapInArrow(encode, _SHARDS).write.option("compression", "none").parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """The documents of a token folder: `doc_id, start, n_tokens, ids`.

    `ids` are little-endian unsigned 32-bit integers, the end id included;
    `start` counts the ids of all documents before. `doc_ids` reads only these.
    """
    ship(spark)
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/shards")
    trained = spark.read.parquet(f"{path}/dictionary").first()
    content, name = bytes(trained["content"]), trained["dict_hash"]
    # One row per part, that is per task that wrote: as few as there were partitions.
    base = (
        shards.groupBy("part")
        .agg(F.sum("n_tokens").alias("n"))
        .select(
            F.col("part").alias("p"),
            (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"),
        )
    )
    wanted = None if doc_ids is None else frozenset(doc_ids)
    if wanted is not None:
        found = F.lit(False)
        for i in sorted(wanted):
            # A shard may begin with documents without an id.
            above = F.col("first_doc").isNull() | (F.col("first_doc") <= i)
            found = found | (above & (F.col("last_doc") >= i))
        shards = shards.where(found)
    out = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared = zstandard.ZstdCompressionDict(content) if content else None
        expand = zstandard.ZstdDecompressor(dict_data=shared).decompress
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "frames"}
                if row["dict_hash"] != name:
                    raise ValueError(f"shard made with dictionary {row['dict_hash']}, not {name}")
                frames = batch.column("frames")[i].as_buffer()
                start, rows = row["base"] + row["local_start"], []
                for doc_id, count, a, b in zip(
                    row["doc_ids"], row["counts"], row["offsets"], row["offsets"][1:]
                ):
                    if wanted is None or doc_id in wanted:
                        ids = np.frombuffer(expand(memoryview(frames)[a:b]), f"<u{row['width']}")
                        rows.append((doc_id, start, count, ids.astype("<u4").tobytes()))
                    start += count
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, f.type) for v, f in zip(zip(*rows), out)], schema=out
                    )

    joined = shards.join(F.broadcast(base), F.col("part") == F.col("p")).select(
        "local_start", "base", "width", "dict_hash", "doc_ids", "counts", "offsets", "frames"
    )
    return joined.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
