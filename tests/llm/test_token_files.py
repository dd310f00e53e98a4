import numpy as np
import pyarrow as pa

from copyloom.llm import token_files, tokens
from copyloom.llm.tokens import coder
from copyloom.plans.workdir import new_path
from tests.llm import odd_rows


def plain(rows):
    c = coder("byte_bpe_50k.json", False)
    return [(i, np.frombuffer(c.whole(t or ""), "<u4").tolist() + [2]) for i, t, _ in rows]


def test_round_trip(spark):
    path = new_path(spark, "tokens")
    words = [(100 + i, f"word{i} and some more of it {i * i}", "en") for i in range(80)]
    token_files.write_tokens(odd_rows.docs(spark, seed_rows=words), path, shard_bytes=500)
    assert spark.read.parquet(f"{path}/dictionary").count() == 1
    assert spark.read.parquet(f"{path}/shards").count() > 2
    got = [
        (r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens)
        for r in token_files.read_tokens(spark, path).collect()
    ]
    got.sort()
    assert [g[1] for g in got][:3] == [None, -3, 1]
    assert [g[1] for g in got[1:]] == sorted(g[1] for g in got[1:])
    start = 0
    for at, _, ids, n in got:
        assert at == start and n == len(ids)
        start += n
    key = str
    assert sorted([(g[1], g[2]) for g in got], key=key) == sorted(plain([*odd_rows.ROWS, *words]), key=key)
    some = token_files.read_tokens(spark, path, [5, 10, 12_345]).collect()
    assert sorted(r.doc_id for r in some) == [5, 10, 10]
    full = {(r[1], r[0]) for r in got}
    assert {(r.doc_id, r.start) for r in some} <= full


def test_empty_and_no_dictionary(spark):
    path = new_path(spark, "tokens")
    token_files.write_tokens(odd_rows.empty(spark), path)
    assert token_files.read_tokens(spark, path).collect() == []
    assert bytes(spark.read.parquet(f"{path}/dictionary").first()["content"]) == b""


def test_pieces_met_before_are_not_learnt_again(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 30)
    make = tokens.Coder("byte_bpe_50k.json", False)
    learnt, learn = [], make._learn
    monkeypatch.setattr(make, "_learn", lambda pieces: (learnt.extend(pieces), learn(pieces)))
    texts = [" ".join(f"{chr(97 + i % 26)}word{chr(97 + i // 26)}" for i in range(80)) + ", a\nB.", "", None]
    for _ in range(3):
        assert make.encode(pa.array(texts, pa.string())) == [make.whole(t or "") for t in texts]
    assert len(learnt) == len(set(learnt)) == 82
