import json
import random

import pytest
from pyspark.sql import functions as F

from copyloom import rules, schemas
from copyloom.functions import answers
from copyloom.operators import generation
from copyloom.streaming import reassembly


def line(text):
    return "data: " + json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})


@pytest.mark.parametrize(
    "raw, text",
    [
        (line("A"), "A"),
        (line(" é\n"), " é\n"),
        ("data: [DONE]", None),
        ("data:  [DONE] ", None),
        (": note", None),
        ("data: {bad", None),
        (line(""), None),
        ('data: {"candidates":[]}', None),
        ('{"candidates":[{"content":{"parts":[{"text":"A"}]}}]}', None),
        ("", None),
    ],
)
def test_chunk_lines(one, raw, text):
    assert one(answers.chunk_text(F.col("l")), l=raw) == text


def test_answer_text(one):
    assert one(answers.answer_text(F.col("b")), b=line("x")[6:]) == "x"
    assert one(answers.answer_text(F.col("b")), b="{}") == ""
    assert one(answers.answer_text(F.col("b")), b=None) == ""


def test_relay_lines(spark):
    df = spark.createDataFrame([*CASES, (7, 0, "chunk", "é\"\n", None)], schemas.RELAY_EVENTS)
    lines = generation.encode_relay(df)
    assert lines.where("request_id = 7").first().line == 'data: {"type":"chunk","text":"é\\"\\n"}\n\n'
    assert sorted(map(str, generation.decode_relay(lines).collect())) == sorted(map(str, df.collect()))
    other = spark.createDataFrame([(1, 0, x) for x in ("data: [DONE]", "data: {", "x", "", 'data: {"type":"ping"}')], schemas.ANSWER_LINES)
    assert generation.decode_relay(other).count() == 0


EN, ZH = "## 📝 Collection Page Copy — X Version", "##📝 中文对照版（供人工校验）"


@pytest.mark.parametrize(
    "text, page, chinese",
    [
        (f"pre\n{EN}\na\n{ZH}\nb\n## 📚 s\n## ✅ t", f"{EN}\na", f"{ZH}\nb"),
        (f"{EN}\na\n{ZH}\nb\n## ✅ t", f"{EN}\na", f"{ZH}\nb"),
        (f"{EN}\na\n## 📚 s", f"{EN}\na\n## 📚 s", ""),
        (f"a\n{ZH}\nb ", f"a\n{ZH}\nb ", f"{ZH}\nb"),
        (" plain ", " plain ", ""),
        ("##\n📝 collection page COPY\nq", "##\n📝 collection page COPY\nq", ""),
    ],
)
def test_sections(one, text, page, chinese):
    assert one(answers.page_section(F.col("t")), t=text) == page
    assert one(answers.chinese_section(F.col("t")), t=text) == chinese


def test_reassemble(spark):
    rows = [(1, 2, "C"), (1, 0, "A"), (1, 1, "B"), (1, 1, "B"), (2, 7, "x")]
    df = spark.createDataFrame(rows, "request_id long, seq long, text string")
    got = {r.request_id: (r.n_chunks, r.text) for r in generation.reassemble(df).collect()}
    assert got == {1: (3, "ABC"), 2: (1, "x")}


def test_fragments(spark):
    rng = random.Random(3)
    want, rows = {}, []
    for request in range(20):
        text = "".join(rng.choice("ab\n") for _ in range(rng.randint(0, 60)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(4))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        rows += [(request, i, p) for i, p in enumerate(parts)]
        want[request] = text.removesuffix("\n").split("\n")
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "request_id long, seq long, fragment string")
    got = {}
    for r in generation.join_fragments(df).orderBy("request_id", "seq").collect():
        got.setdefault(r.request_id, []).append(r.line)
    assert got == {r: lines for r, lines in want.items() if lines != [""]}


def events(*rows):
    return [(r, s, k, t, m) for r, s, k, t, m in rows]


CASES = events(
    (1, 1, "chunk", "B", None), (1, 0, "chunk", "A", None), (1, 2, "done", None, None),
    (2, 0, "chunk", "A", None), (2, 1, "error", None, "gone"),
    (3, 0, "chunk", "A", None), (3, 0, "chunk", "A", None), (3, 1, "done", None, None),
    (5, 0, "done", None, None),
)
ENDED = {
    1: (2, "AB", "done", None), 2: (1, "A", "error", "gone"), 3: (1, "A", "done", None), 5: (0, "", "done", None),
}


def result(df):
    return {r.request_id: (r.n_chunks, r.text, r.status, r.message) for r in df.collect()}


def test_close_in_batch(spark):
    df = spark.createDataFrame([*CASES, (4, 0, "chunk", "A", None)], schemas.RELAY_EVENTS)
    assert result(generation.close_generations(df)) == ENDED | {4: (1, "A", "open", None)}


class Feed:
    """A folder that a stream reads; each `add` is a new file."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema
        folder.mkdir()

    def add(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.folder)


def drain(stream, tmp_path, name="out"):
    query = (
        stream.writeStream.option("checkpointLocation", str(tmp_path / f"{name}-progress"))
        .trigger(availableNow=True).format("parquet").option("path", str(tmp_path / name)).start()
    )
    assert query.awaitTermination(120)
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name))


@pytest.fixture
def rocksdb(spark):
    reassembly.use_rocksdb(spark)
    yield
    spark.conf.unset(reassembly.STATE_STORE)


def test_stream_restart_equals_batch(spark, tmp_path, rocksdb):
    feed = Feed(spark, tmp_path / "in", schemas.RELAY_EVENTS)
    run = lambda: drain(reassembly.assemble(feed.stream(), None, None), tmp_path)
    feed.add(*CASES[:2], *CASES[3:4], *CASES[5:6])
    assert result(run()) == {}
    # The end mark arrives before a position in front of it.
    feed.add((6, 1, "chunk", "b", None), (6, 2, "done", None, None), *CASES[2:3], *CASES[4:5], *CASES[6:])
    assert result(run()) == ENDED
    # Late repeats of a closed generation change nothing.
    feed.add((6, 0, "chunk", "a", None), (1, 0, "chunk", "A", None), (1, 2, "done", None, None))
    rows = run()
    assert result(rows) == ENDED | {6: (2, "ab", "done", None)}
    assert rows.count() == len(ENDED) + 1


def test_random_arrivals_equal_batch(spark, tmp_path, rocksdb):
    rng = random.Random(8)
    events = []
    for r in range(100, 130):
        n = rng.randint(0, 5)
        events += [(r, i, "chunk", f"{r}.{i};", None) for i in range(n + rng.choice([0, 0, 2]))]
        events += [(r, n, rng.choice(["done", "error"]), None, "note")] * rng.choice([1, 1, 2])
        if rng.random() < 0.3:
            events.append((r, n + 1, rng.choice(["done", "error"]), None, "late"))
        if n and rng.random() < 0.3:
            events.append((r, 0, "chunk", f"{r}.0;", None))
    # No position may hold both a chunk and the end that counts.
    events = [e for e in events if e[2] != "chunk" or not any(x[0] == e[0] and x[1] == e[1] and x[2] != "chunk" for x in events)]
    rng.shuffle(events)
    feed = Feed(spark, tmp_path / "in", schemas.RELAY_EVENTS)
    for at in range(0, len(events), 60):
        feed.add(*events[at : at + 60])
        got = drain(reassembly.assemble(feed.stream(), None, None), tmp_path)
    batch = generation.close_generations(spark.createDataFrame(events, schemas.RELAY_EVENTS))
    assert result(got) == result(batch)
    assert got.count() == 30


def test_time_out_in_batch(spark):
    rows = [(1, 0, "chunk", "A", None, 0), (1, 1, "chunk", "B", None, 500), (2, 0, "chunk", "x", None, 900), (3, 0, "done", None, None, 0)]
    events = spark.createDataFrame(rows, "request_id long, seq long, type string, text string, message string, s long")
    events = events.withColumn("at", F.timestamp_seconds("s")).drop("s")
    got = result(generation.close_generations(events, F.timestamp_seconds(F.lit(1000)), 600_000))
    assert got == {1: (2, "AB", "timeout", None), 2: (1, "x", "open", None), 3: (0, "", "done", None)}


def test_stream_time_out(spark, tmp_path, rocksdb):
    import time

    feed = Feed(spark, tmp_path / "in", schemas.RELAY_EVENTS)
    feed.add((1, 0, "chunk", "A", None), (2, 0, "chunk", "B", None), (2, 1, "done", None, None))
    done = reassembly.assemble(feed.stream(), timeout_ms=2000)
    query = (
        done.writeStream.option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(processingTime="1 second").format("parquet").option("path", str(tmp_path / "out")).start()
    )
    try:
        for _ in range(60):
            time.sleep(1)
            assert query.exception() is None
            got = result(spark.read.schema(done.schema).parquet(str(tmp_path / "out"))) if (tmp_path / "out").exists() else {}
            if len(got) == 2:
                break
    finally:
        query.stop()
    assert got == {1: (1, "A", "timeout", None), 2: (1, "B", "done", None)}


def test_stream_framing(spark, tmp_path, rocksdb):
    feed = Feed(spark, tmp_path / "in", schemas.FRAGMENTS)
    run = lambda: drain(reassembly.frame_lines(feed.stream(), None), tmp_path)
    feed.add((1, 0, "da", False), (1, 2, "\nx", False), (2, 0, "q", True))
    run()
    feed.add((1, 1, "ta\nsecond", False), (1, 3, "y", True), (1, 0, "da", False))
    got = sorted(tuple(r) for r in run().collect())
    assert got == [(1, 0, "data"), (1, 1, "second"), (1, 2, "xy"), (2, 0, "q")]


def test_live_text(spark, tmp_path, rocksdb):
    schema = schemas.struct(request_id=schemas.LONG, seq=schemas.LONG, text=schemas.STRING)
    feed = Feed(spark, tmp_path / "in", schema)
    feed.add((1, 1, "B"), (1, 0, "A"), (1, 0, "A"), (1, 0, "Z"), (2, 0, "x"))
    live = reassembly.run_to_table(reassembly.live_text(feed.stream(), None), "live", "update")
    assert {tuple(r) for r in live.collect()} == {(1, 2, "AB"), (2, 1, "x")}
    batch = generation.reassemble(spark.read.schema(schema).parquet(feed.folder))
    assert {tuple(r) for r in batch.collect()} == {(1, 2, "AB"), (2, 1, "x")}


def test_deltas_put_together(spark, tmp_path, rocksdb):
    schema = schemas.struct(request_id=schemas.LONG, seq=schemas.LONG, text=schemas.STRING)
    feed = Feed(spark, tmp_path / "in", schema)
    run = lambda: [tuple(r) for r in drain(reassembly.text_deltas(feed.stream(), None), tmp_path).orderBy("request_id", "seq").collect()]
    feed.add((1, 0, "A😀"), (1, 2, "C"), (2, 1, "y"), (1, 0, "B"))
    assert run() == [(1, 0, 1, 0, "A😀")]
    feed.add((1, 1, None), (1, 0, "0"), (1, 3, "D"), (2, 1, "x"))
    assert run() == [(1, 0, 1, 0, "A😀"), (1, 1, 3, 2, "CD")]
    feed.add((2, 0, "w"), (1, 5, "F"))
    assert run()[2:] == [(2, 0, 2, 0, "wx")]


class Calls:
    """A state value that counts what is asked of it."""

    def __init__(self):
        self.value, self.n = None, 0

    def get(self):
        self.n += 1
        return self.value

    def update(self, value):
        self.n += 1
        self.value = value

    def exists(self):
        self.n += 1
        return self.value is not None


class Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, schema, ttl=None):
        return self.states.setdefault(name, Calls())


@pytest.mark.parametrize("kind", ["_Live", "_Deltas", "_Assembly"])
def test_state_calls_do_not_grow_with_chunks(kind):
    import pandas as pd

    used = []
    for n in (2, 500):
        processor = getattr(reassembly, kind)(*([None, None] if kind == "_Assembly" else [None]))
        handle = Handle()
        processor.init(handle)
        frame = pd.DataFrame({"seq": range(n), "type": "chunk", "text": "x", "message": None})
        list(processor.handleInputRows((1,), iter([frame]), None))
        used.append(sum(s.n for s in handle.states.values()))
    assert used[0] == used[1] <= 4


def test_time_out_by_the_times_in_the_stream(spark, tmp_path, rocksdb):
    schema = "request_id long, seq long, text string, s long"

    def feed(*rows):
        spark.createDataFrame(list(rows), schema).withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "in"))

    def run():
        kinds = spark.read.parquet(str(tmp_path / "in")).schema
        stream = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
        return result(drain(reassembly.timed_out(stream, 100_000, "10 seconds"), tmp_path))

    feed((1, 1, "B", 1050), (1, 0, "A", 1000), (1, 2, "late", 1100), (2, 0, "x", 1060))
    assert run() == {}
    feed((3, 0, "y", 1109), (1, 3, "C", 1099))
    assert run() == {}  # 10 seconds are left
    feed((3, 1, "z", 1110))
    assert run() == {1: (3, "ABC", "timeout", None)}
    # A request that is over stays so, and one that begins earlier than it seemed ends earlier.
    feed((1, 4, "D", 1110), (4, 1, "q", 1150), (4, 0, "p", 1110))
    assert run() == {1: (3, "ABC", "timeout", None)}
    feed((9, 0, "-", 1220))
    assert run() == {
        1: (3, "ABC", "timeout", None), 2: (1, "x", "timeout", None), 3: (2, "yz", "timeout", None), 4: (2, "pq", "timeout", None),
    }


def test_bytes_cut_at_every_place(spark, tmp_path, rocksdb):
    text = "é😀\r\nb\n\n\rü"
    data = text.encode() + b"\xff"
    rows, number = [], 0
    for a in range(len(data) + 1):
        b = min(len(data), a + 1)
        rows += [(number, 0, data[:a], False), (number, 1, data[a:b], False), (number, 2, data[b:], True)]
        number += 1
    schema = "request_id long, seq long, fragment binary, last boolean"
    rng = random.Random(2)
    rng.shuffle(rows)
    for at in range(0, len(rows), 20):
        spark.createDataFrame(rows[at : at + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    for r in drain(reassembly.frame_bytes(stream, None), tmp_path).orderBy("request_id", "seq").collect():
        got.setdefault(r.request_id, []).append(r.line)
    assert got == {i: ["é😀", "b", "", "\rü\ufffd"] for i in range(number)}


def test_lines_to_text(spark):
    rows = [(1, 0, line("A")), (1, 1, ": x"), (1, 2, line("B")), (1, 3, "data: " + rules.END_LINE)]
    df = spark.createDataFrame(rows, schemas.ANSWER_LINES)
    assert generation.reassemble(generation.decode_lines(df)).first().text == "AB"


class _Counted:
    """A state value that counts how often it is reached."""

    def __init__(self):
        self.value, self.reached = None, 0

    def getValueState(self, name, schema, ttl=None):
        return self

    def get(self):
        self.reached += 1
        return self.value

    def update(self, value):
        self.reached += 1
        self.value = value


@pytest.mark.parametrize("kind, coded", [(reassembly._Framing, str), (reassembly._ByteFraming, str.encode)])
def test_framing_reaches_state_twice_a_batch(kind, coded):
    from pyspark.sql import Row

    text = "a\nb\n\nlong line\nend"
    fragments = [Row(seq=i, fragment=coded(text[i]), last=i == len(text) - 1) for i in range(len(text))]
    state, framing, found = _Counted(), kind(None), []
    framing.init(state)
    for n, batch in enumerate([fragments[1::2], fragments[::2], fragments[:3]], 1):
        found += framing.handleInputRows((7,), iter(batch), None)
        assert state.reached <= 2 * n
    assert [(r.request_id, r.seq, r.line) for r in found] == [(7, i, x) for i, x in enumerate(text.split("\n"))]
