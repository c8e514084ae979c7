"""Frames by batch and stream, whatever the splits; oversize and malformed ones as rows."""

import io
import json
import random

from loomspark.sources import frames as X


def _request(n, **more):
    return json.dumps({"jsonrpc": "2.0", "id": n, "method": "m", **more}).encode()


def _lines(rng):
    out = []
    for n in range(60):
        out.append(rng.choice([_request(n, params="é" * rng.randint(0, 90)), b'{"jsonrpc":"2.0","method":"note"}', b"", b"{", b"[1]", b"\xff", _request(True), _request("a"), b'{"jsonrpc":"1.0","id":1,"method":"m"}', b"x" * rng.randint(195, 300)]))
    return out


def test_any_split_gives_the_same_frames():
    rng = random.Random(1)
    lines = _lines(rng)
    data = b"\n".join(lines) + b"\n" + b"tail"
    want, at = [], 0
    for x in [*lines, b"tail"]:
        want.append((at, len(x), x if len(x) <= 200 else None))
        at += len(x) + 1
    for split in (1, 7, 64, 1000, 10**6):
        got = [f for a in range(0, len(data), split) for f in X.frames(io.BytesIO(data), a, min(a + split, len(data)), len(data), 200)]
        assert got == want, split


def test_kinds():
    kind = lambda x: X.parse_frame(x)[0]
    assert X.parse_frame(_request(7)) == ("request", "7", "m", _request(7).decode())
    assert kind(b'{"jsonrpc":"2.0","method":"n"}') == "notification"
    assert {kind(x) for x in (b"", b"[]", b"\xff", b'{"id":1}', _request(None), _request(True), _request(1.5), b'{"jsonrpc":"2.0","id":1}')} == {"malformed"}


def test_batch_and_stream(spark, tmp_path):
    X.register(spark)
    rng, folder = random.Random(2), tmp_path / "in"
    folder.mkdir()
    lines = _lines(rng)
    (folder / "a").write_bytes(b"\n".join(lines) + b"\nhalf")
    (folder / "b").write_bytes(_request(1) + b"\n" + b"y" * 500)
    read = spark.read.format("frames").option("maxFrameBytes", 200).option("splitBytes", 97)
    batch = read.load(str(folder)).collect()
    assert len(batch) == len(lines) + 1 + 2 and {r.kind for r in batch} == {"request", "notification", "malformed", "oversize"}
    assert all(r.json is None for r in batch if r.kind in ("oversize", "malformed")) and [r.size for r in batch if r.kind == "oversize" and r.path.endswith("b")] == [500]

    def run():
        got = []
        q = spark.readStream.format("frames").option("maxFrameBytes", 200).option("splitBytes", 97).load(str(folder))
        q.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start().awaitTermination()
        return sorted((r.path[-1], r.offset, r.kind) for r in got)

    whole = sorted((r.path[-1], r.offset, r.kind) for r in batch)
    first = run()
    assert first == [r for r in whole if r[:2] not in {(p, max(o for q, o, _ in whole if q == p)) for p in "ab"}]
    with (folder / "a").open("ab") as f:
        f.write(b" done\n" + _request(99) + b"\n")
    assert [(p, k) for p, _, k in run()] == [("a", "malformed"), ("a", "request")]
