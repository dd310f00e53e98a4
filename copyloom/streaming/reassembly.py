"""Answers as streams: line framing, reassembly with end mark and time-out, live text."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from copyloom import rules, schemas
from copyloom.plans.workdir import new_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# What the processors keep per request.
_SEQS = T.ArrayType(schemas.LONG)
HELD = schemas.struct(seqs=_SEQS, texts=schemas.STRINGS)
OPEN = schemas.struct(
    seqs=_SEQS, texts=schemas.STRINGS, end=schemas.LONG, status=schemas.STRING, message=schemas.STRING
)
PREFIX = schemas.struct(next=schemas.LONG, offset=schemas.LONG, seqs=_SEQS, texts=schemas.STRINGS)
DATED = schemas.struct(begun=schemas.LONG, seqs=_SEQS, texts=schemas.STRINGS, ats=_SEQS)
def _framed(kind: T.DataType) -> T.StructType:
    return schemas.struct(
        next=schemas.LONG, lines=schemas.LONG, tail=kind,
        seqs=_SEQS, fragments=T.ArrayType(kind), lasts=T.ArrayType(schemas.BOOLEAN), closed=schemas.BOOLEAN,
    )


FRAMED = _framed(schemas.STRING)
BYTES = _framed(T.BinaryType())
CLOSED = schemas.struct(yes=schemas.BOOLEAN)


class _Framing(StatefulProcessor):
    """Cuts the arrivals of a request into lines; keeps the unfinished tail.

    Arrivals may come out of order: those ahead of the next position wait.
    All that is kept of a request is one state value, read and written once a
    batch. Behind the last fragment only its flag stays, which expires on its
    own, as does what waits for a fragment that never comes.
    """

    state, empty = FRAMED, ""

    def __init__(self, ttl_ms: int | None) -> None:
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getValueState("open", self.state, self._ttl)

    def _arrive(self, waiting: dict, seq: int, fragment, last: bool) -> None:
        waiting[seq] = (fragment or "", last)

    def _lines(self, parts: list, ended: bool) -> tuple[list[str], str]:
        *done, tail = "".join(parts).split("\n")
        return (done + [tail] if ended and tail else done), tail

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        upcoming, count, tail, seqs, fragments, lasts, closed = self._open.get() or (0, 0, self.empty, (), (), (), False)
        if closed:
            for _ in rows:
                pass
            return
        waiting = {s: (f, end) for s, f, end in zip(seqs, fragments, lasts)}
        for row in rows:
            if row["seq"] >= upcoming:
                self._arrive(waiting, row["seq"], row["fragment"], bool(row["last"]))
        parts, ended = [tail], False
        while not ended and upcoming in waiting:
            fragment, ended = waiting.pop(upcoming)
            parts.append(fragment)
            upcoming += 1
        lines, tail = self._lines(parts, ended)
        if ended:
            self._open.update((upcoming, count, self.empty, [], [], [], True))
        else:
            self._open.update(
                (upcoming, count + len(lines), tail, list(waiting), [f for f, _ in waiting.values()], [e for _, e in waiting.values()], False)
            )
        for place, line in enumerate(lines, count):
            yield Row(request_id=key[0], seq=place, line=line)

    def close(self) -> None:
        pass


def frame_lines(fragments: DataFrame, ttl_ms: int | None = 86_400_000) -> DataFrame:
    """Stream of raw arrivals (`request_id, seq, fragment, last`) → stream of lines.

    What is kept of a request expires after `ttl_ms`; with None it can be run
    to the end of what is there, as `assemble`. Arrivals without a request are left out.
    """
    return fragments.where("request_id is not null").groupBy("request_id").transformWithState(
        statefulProcessor=_Framing(ttl_ms),
        outputStructType=schemas.ANSWER_LINES,
        outputMode="append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )


class _ByteFraming(_Framing):
    """Cuts arrivals of bytes into lines, wherever a character or line end was cut.

    The bytes behind the last line end wait undecoded, so a character is decoded
    when its line is whole.
    """

    state, empty = BYTES, b""

    def _arrive(self, waiting: dict, seq: int, fragment, last: bool) -> None:
        waiting.setdefault(seq, (bytes(fragment or b""), last))

    def _lines(self, parts: list, ended: bool) -> tuple[list[str], bytes]:
        *done, tail = b"".join(map(bytes, parts)).split(b"\n")
        # A carriage return at the end stays in the tail until what follows is there.
        lines = [line.removesuffix(b"\r") for line in done]
        if ended and tail:
            lines.append(tail)
        return [line.decode("utf-8", "replace") for line in lines], tail


def frame_bytes(fragments: DataFrame, ttl_ms: int | None = 86_400_000) -> DataFrame:
    """Stream of raw arrivals (`request_id, seq, fragment` as BINARY, `last`) → stream of lines.

    Lines end with a newline, or a carriage return and a newline; the unfinished
    last one is a line as well. Bytes that are no UTF-8 become the replacement
    character. Of repeats the first counts. `ttl_ms` and arrivals without a
    request as in `frame_lines`.
    """
    return fragments.where("request_id is not null").groupBy("request_id").transformWithState(
        statefulProcessor=_ByteFraming(ttl_ms),
        outputStructType=schemas.ANSWER_LINES,
        outputMode="append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )


def _take(held: dict[int, str], seq: int, text: str | None) -> None:
    """A chunk at its position, where of two the smaller text counts, as in batch."""
    text = text or ""
    if seq not in held or text < held[seq]:
        held[seq] = text


class _Assembly(StatefulProcessor):
    """Collects the chunks of one generation until it ends.

    All chunks of a request are one state value, read and written once a batch.
    Of two at one position the smaller text counts, as in batch. A generation ends when its first end mark or error is there and
    no position before it is missing, or when the timer fires. Positions behind
    the end don't count. A closed generation leaves a flag behind, so that late
    repeats do not open it again; the flag expires on its own.
    """

    def __init__(self, timeout_ms: int | None, closed_ttl_ms: int | None) -> None:
        self._timeout, self._ttl = timeout_ms, closed_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", OPEN)
        self._closed = handle.getValueState("closed", CLOSED, self._ttl)

    def _result(self, key, held: dict[int, str], status: str, message: str | None) -> pd.DataFrame:
        self._open.clear()
        self._closed.update((True,))
        if self._timeout is not None:
            for at in list(self._handle.listTimers()):
                self._handle.deleteTimer(at)
        return pd.DataFrame(
            {
                "request_id": [key[0]],
                "n_chunks": [len(held)],
                "text": ["".join(held[k] for k in sorted(held))],
                "status": [status],
                "message": [message],
            }
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self._closed.exists():
            for _ in rows:
                pass
            return
        before = self._open.get()
        seqs, texts, end, status, message = before or ((), (), None, None, None)
        held = dict(zip(seqs, texts))
        for batch in rows:
            for seq, kind, text, note in zip(
                batch["seq"], batch["type"], batch["text"], batch["message"]
            ):
                seq = int(seq)
                if kind == "chunk":
                    _take(held, seq, text)
                elif kind in ("done", "error") and (
                    end is None or (seq, kind != "error") < (end, status != "error")
                ):
                    end, status, message = seq, kind, note
        if end is not None:
            inside = {k: v for k, v in held.items() if k < end}
            if len(inside) >= end:
                yield self._result(key, inside, status, message)
                return
        self._open.update((list(held), list(held.values()), end, status, message))
        if self._timeout is not None and before is None:
            now = timerValues.getCurrentProcessingTimeInMs()
            self._handle.registerTimer(now + self._timeout)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seqs, texts, *_ = self._open.get()
        yield self._result(key, dict(zip(seqs, texts)), "timeout", None)

    def close(self) -> None:
        pass


def assemble(
    events: DataFrame,
    timeout_ms: int | None = rules.GENERATION_TIMEOUT_MS,
    closed_ttl_ms: int | None = 86_400_000,
) -> DataFrame:
    """Stream of relay events → one row per finished generation.

    `seq` counts the events of a request from 0, the end mark included. A
    generation holds at most `rules.MAX_OUTPUT_TOKENS` tokens, which bounds
    the state of a key. Needs the RocksDB state store (`use_rocksdb`).

    With a time-out or an expiring flag the query needs a processing-time
    trigger: timers keep it going, so an available-now run would not end. With
    both None it can be run either way.
    """
    timed = timeout_ms is not None or closed_ttl_ms is not None
    return events.groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=_Assembly(timeout_ms, closed_ttl_ms),
        outputStructType=schemas.GENERATIONS,
        outputMode="append",
        timeMode="ProcessingTime" if timed else "None",
    )


class _Live(StatefulProcessor):
    """Keeps the chunks of a request by position, for a while, and tells its text so far."""

    def __init__(self, ttl_ms: int | None) -> None:
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getValueState("held", HELD, self._ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = dict(zip(*(self._held.get() or ((), ()))))
        for batch in rows:
            for seq, text in zip(batch["seq"], batch["text"]):
                _take(held, int(seq), text)
        self._held.update((list(held), list(held.values())))
        text = "".join(held[k] for k in sorted(held))
        yield pd.DataFrame({"request_id": [key[0]], "n_chunks": [len(held)], "text": [text]})

    def close(self) -> None:
        pass


class _Deltas(StatefulProcessor):
    """Hands the text of a request on as its gap-free beginning grows.

    Of the beginning only its number of chunks and characters is kept; chunks
    behind a gap wait. One state value is read and written once a batch.
    """

    def __init__(self, ttl_ms: int | None) -> None:
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._prefix = handle.getValueState("prefix", PREFIX, self._ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        upcoming, offset, seqs, texts = self._prefix.get() or (0, 0, (), ())
        waiting = dict(zip(seqs, texts))
        for batch in rows:
            for seq, text in zip(batch["seq"], batch["text"]):
                if seq >= upcoming:
                    _take(waiting, int(seq), text)
        first, added = upcoming, []
        while upcoming in waiting:
            added.append(waiting.pop(upcoming))
            upcoming += 1
        text = "".join(added)
        self._prefix.update((upcoming, offset + len(text), list(waiting), list(waiting.values())))
        if added:
            yield pd.DataFrame(
                {"request_id": [key[0]], "seq": [first], "n_chunks": [len(added)], "offset": [offset], "added": [text]}
            )

    def close(self) -> None:
        pass


DELTAS = schemas.struct(
    request_id=schemas.LONG, seq=schemas.LONG, n_chunks=schemas.LONG, offset=schemas.LONG, added=schemas.STRING
)


def text_deltas(chunks: DataFrame, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """Stream of chunks → what each batch adds to the gap-free beginning of each text, append mode.

    `request_id, seq` (of the first chunk added), `n_chunks, offset` (characters
    before, code points) and `added`. Of repeats in one batch, or while they
    wait, the smaller text counts; what has been handed on is not taken back.
    State expires after `ttl_ms`; with None it can be run to the end of what is there.
    """
    return chunks.groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=_Deltas(ttl_ms),
        outputStructType=DELTAS,
        outputMode="append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )


_NOTHING = pd.DataFrame({c: pd.Series(dtype=object) for c in schemas.GENERATIONS.names})


class _Timed(StatefulProcessor):
    """Chunks of a request until a time after its first one, by the times in the data."""

    def __init__(self, timeout_ms: int) -> None:
        self._timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", DATED)
        self._closed = handle.getValueState("closed", CLOSED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = self._closed.exists()
        begun, seqs, texts, ats = (None if closed else self._open.get()) or (None, (), (), ())
        held = {(s, a): t for s, t, a in zip(seqs, texts, ats)}
        before = begun
        for batch in rows:
            if closed:
                continue
            times = batch["at"].astype("datetime64[us]").astype("int64") // 1000
            for seq, text, at in zip(batch["seq"], batch["text"], times):
                begun = int(at) if begun is None else min(begun, int(at))
                _take(held, (int(seq), int(at)), text)
        if closed or begun is None:
            yield _NOTHING
            return
        # What comes later than the time-out can't count, whenever the timer fires.
        held = {k: v for k, v in held.items() if k[1] < begun + self._timeout}
        self._open.update((begun, [k[0] for k in held], list(held.values()), [k[1] for k in held]))
        if begun != before:
            if before is not None:
                self._handle.deleteTimer(before + self._timeout)
            self._handle.registerTimer(begun + self._timeout)
        yield _NOTHING

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, seqs, texts, _ = self._open.get()
        self._open.clear()
        self._closed.update((True,))
        held: dict[int, str] = {}
        for seq, text in zip(seqs, texts):
            _take(held, seq, text)
        yield pd.DataFrame(
            {
                "request_id": [key[0]],
                "n_chunks": [len(held)],
                "text": ["".join(held[k] for k in sorted(held))],
                "status": ["timeout"],
                "message": [None],
            }
        )

    def close(self) -> None:
        pass


def timed_out(chunks: DataFrame, timeout_ms: int = rules.GENERATION_TIMEOUT_MS, late: str = "0 seconds") -> DataFrame:
    """Stream of chunks that never end (`request_id, seq, text, at`) → those whose time is over.

    The time runs from a request's first chunk by the times `at`, and is over
    when the watermark, `late` behind the latest time, has passed; no wall clock
    is read, so it runs as available-now as well. Chunks at or behind the end of
    the time don't count, nor do those later than the watermark. A flag stays for
    each request that is over.
    """
    return (
        chunks.select("request_id", "seq", "text", "at")
        .withWatermark("at", late)
        .groupBy("request_id")
        .transformWithStateInPandas(
            statefulProcessor=_Timed(timeout_ms),
            outputStructType=schemas.GENERATIONS,
            outputMode="append",
            timeMode="EventTime",
        )
    )


LIVE = schemas.struct(request_id=schemas.LONG, n_chunks=schemas.LONG, text=schemas.STRING)


def live_text(chunks: DataFrame, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """Stream of chunks → the text so far of each request that a batch has touched, in update mode.

    A position counts once, with its smaller text. Chunks expire after `ttl_ms`;
    with None it can be run to the end of what is there, as `assemble`.
    """
    return chunks.groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=_Live(ttl_ms),
        outputStructType=LIVE,
        outputMode="update",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )


def run_to_table(stream: DataFrame, name: str, mode: str = "append", key: str = "request_id") -> DataFrame:
    """Run a stream over all input that is there, into a fresh table of the shared folder.

    With mode "update" each batch adds its rows, and the last one of each `key`
    is read.
    """
    spark = stream.sparkSession
    path = new_path(spark, name)
    writer = stream.writeStream.outputMode(mode).option(
        "checkpointLocation", new_path(spark, f"{name}-progress")
    ).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        # The number names the folder, so that a batch that is done again replaces itself.
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")
    writer.foreachBatch(write).start().awaitTermination()
    rows = spark.read.option("basePath", path).parquet(path)
    last = rows.groupBy(F.col(key).alias("_key")).agg(F.max("batch").alias("_batch"))
    same = (F.col(key) == F.col("_key")) & (F.col("batch") == F.col("_batch"))
    return rows.join(last, same, "left_semi").drop("batch")


@contextmanager
def rocksdb(spark):
    """The state store that stateful processors need, for queries started inside."""
    before = spark.conf.get(STATE_STORE, None)
    use_rocksdb(spark)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def use_rocksdb(spark) -> None:
    """Stateful processors need this state store; set it before the query starts."""
    spark.conf.set(STATE_STORE, ROCKSDB)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
