"""op12 against a trie of plain dicts; LOUDS; awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from loomspark.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def _plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        return [k, *(y for x in kids.get(k, []) for y in below(x))]

    for k, members in nodes.items():
        sub = below(k)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(k)))
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in sub if x)
        out[min(members), len(k)] = (min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, [])), sum(x not in kids for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest())
    assert len(out) == len(nodes)
    return out


def _rows(rng):
    rows = []
    for conv in [*rng.sample(range(400), 150), None, 100, 300]:
        many = rng.choice([1, 1, 2, 3, 5, 8])
        for turn in [*range(many), *([None] if rng.random() < 0.1 else [])]:
            rows.append((conv, turn, rng.choice(["user", "user", None]), rng.choice(["a", "bé😀", "", None, "long " * 3000 if rng.random() < 0.1 else "c"])))
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize("heavy", [4096, 1, 3, 20])
def test_trie_equals_plain(spark, tmp_path, heavy):
    rows = _rows(random.Random(heavy))
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "'x' as node", "2 as depth", "3 as head").write.parquet(f"{tmp_path}/conversations.parquet")
    docs = spark.read.parquet(f"{tmp_path}/conversations.parquet")
    got = (tries.op12_prefixtrie(spark, str(tmp_path)) if heavy == 4096 else tries.trie(docs, heavy)).collect()
    want = _plain(rows)
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == want and len(got) == len(want)


def test_shards_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(tries, "SHARD", 5)
    rows = _rows(random.Random(9))
    got = tries.trie(spark.createDataFrame(rows, SCHEMA), 10).collect()
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == _plain(rows)


def test_empty_and_turnless(spark):
    frame = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert tries.trie(frame).count() == 0
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(lone, 0, "user", "x")]  # its only turn is replaced by those of an absent conversation
    got = tries.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == _plain(rows) and got[0].n_leaves == 1


def test_repeated_rows_stay(spark):
    rows = [(0, 1, "user", "x"), (0, 1, "user", "x"), (0, None, "user", "y")]
    got = tries.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == _plain(rows)


def test_louds():
    degrees = np.array([2, 3, 0, 0, 1, 0, 0])
    bits = tries.louds(degrees)
    assert bits.tolist() == [1, 1, 0, 1, 1, 1, 0, 0, 0, 1, 0, 0, 0]
    assert tries.louds_degrees(bits).tolist() == degrees.tolist()
    assert tries.louds_parents(bits).tolist() == [0, 0, 1, 1, 1, 4]
    assert tries.louds_parents(bits).size + 1 == len(degrees)
