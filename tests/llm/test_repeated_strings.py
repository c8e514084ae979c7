"""op13 against dictionaries of all 50-byte strings; its suffix sorting against plain sorting."""

import hashlib
import random

import numpy as np
import pytest

from loomspark.llm import suffixes
from loomspark.llm.suffixes import LENGTH


def _plain(rows):
    """rows: (doc_id, text) -> sorted result rows."""
    least = {}
    bodies = [(d, (t or "").encode()) for d, t in rows]
    for d, b in bodies:
        if d is not None:
            for i in range(len(b) - LENGTH + 1):
                x = b[i : i + LENGTH]
                least[x] = min(d, least.get(x, d))
    out = []
    for d, b in bodies:
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - LENGTH + 1):
                if least[b[i : i + LENGTH]] < d:
                    gone[i : i + LENGTH] = b"\1" * LENGTH
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _query(spark, rows, *sizes):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pack", "'x' as digest", "array(1) as firsts")
    return sorted((tuple(r)[:3] + (len(r.spans), r.kept_sha256) for r in suffixes.repeated_strings(docs, *sizes).collect()), key=str)


def _texts(rng, many):
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(12)] + ["a" * 300, "-" * 60, "ab" * 90]
    out = []
    for _ in range(many):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 6))]
        out.append(rng.choice([" ", "", "\n"]).join(parts))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_query_equals_dictionaries(spark, seed):
    rng = random.Random(seed)
    # many packs, pieces, buckets and blocks, down to windows dealt one by one
    sizes = [(), (suffixes.Sizes(3000, 70, 7, 1500, 20_000, 5_000),), (suffixes.Sizes(3000, 1000, 50, 60, 20_000, 50_000),)][seed]
    texts = _texts(rng, 120)
    rows = [(rng.randint(0, 90), t) for t in texts] + [(rng.randint(0, 90), rng.choice(texts)) for _ in range(30)]
    rows += [(None, texts[0]), (None, "only here " * 20), (5, None), (6, ""), (-3, texts[1]), rows[0], (7, "x" * 49), (8, "x" * 49), (3, "y" * 50), (9, "y" * 50)]
    assert _query(spark, rows, *sizes) == _plain(rows)


def test_long_text(spark):
    rng = random.Random(4)
    long = " ".join(str(rng.random()) for _ in range(40_000))
    rows = [(2, long), (1, long[300_000:300_050]), (3, "z" + long[5:54]), (4, "z" + long[5:55] + "z"), (5, long[::-1])]
    assert _query(spark, rows) == _plain(rows)


def test_empty_table(spark):
    assert suffixes.repeated_strings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh \n", b"a"])
def test_two_stage_order(letters):
    rng = random.Random(len(letters))
    strings = [bytes(rng.choice(letters) for _ in range(rng.randint(50, 130))) for _ in range(60)]
    strings += [strings[3], strings[5][10:80], b"a" * 90]
    text = np.frombuffer(b"\xff" + b"\xff".join(strings) + b"\xff" * 70, np.uint8) + np.uint8(1)
    starts, at = [], 1
    for x in strings:
        starts += range(at, at + len(x) - 49)
        at += len(x) + 1
    starts = np.array(starts)
    order = suffixes.two_stage(text, starts)
    keys = [text[i : i + 50].tobytes() for i in order]
    assert sorted(order.tolist()) == starts.tolist() and keys == sorted(keys)
    prefixes = suffixes.common_prefixes(text, order)
    for i in range(1, len(order)):
        n = next((k for k in range(50) if keys[i][k] != keys[i - 1][k]), 50)
        assert prefixes[i] == n


def test_smaller_than_next():
    text = np.frombuffer(b"\0aabbaac\0cba\0\0", np.uint8)
    want = [text[i:].tobytes() < text[i + 1 :].tobytes() or text[i] == 0 for i in range(len(text) - 1)]
    assert suffixes.smaller_than_next(text)[:-1].tolist() == want
