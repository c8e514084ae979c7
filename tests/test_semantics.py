"""Hand-made cases: ties, nulls, bounds, order."""

import datetime as dt
import io
import json
import uuid

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import graph, graph_mutations, ledger, memory, search, session
from loomspark.sources import cli
from loomspark.streaming import ledger_stream

M = "id string, version long, title string, content string, concepts array<string>"


def mem(spark, rows):
    return spark.createDataFrame([(i, v, t, c, []) for i, v, t, c in rows], M)


def test_heads_never_go_back(spark):
    m = mem(spark, [("a", 1, "t", "x"), ("a", 3, "t", "y"), ("a", 2, "t", "z")])
    assert [(r.version, r.content) for r in memory.heads(m).collect()] == [(3, "y")]


def test_pages(spark):
    m = mem(spark, [("a", v, "t", "x") for v in range(1, 6)])
    seen = [memory.list_versions(m, "a", o, 2).orderBy("position").collect() for o in (0, 2, 4, 9)]
    assert [[r.version for r in p] for p in seen] == [[5, 4], [3, 2], [1], []]
    assert [p[0].next_offset if p else None for p in seen] == [2, 4, None, None]
    with pytest.raises(ValueError):
        memory.list_versions(m, "a", 0, 101)


def test_vector_visibility(spark):
    m = mem(spark, [("up", 1, "t", "x"), ("diag", 1, "t", "x"), ("side", 1, "t", "x"), ("old", 1, "t", "x"), ("old", 2, "t", "x"), ("neg", 1, "t", "x"), ("dim", 1, "t", "x")])
    e = spark.createDataFrame([("up", 1, [7.0, 0.0]), ("diag", 1, [1.0, 1.0]), ("side", 1, [0.0, 7.0]), ("old", 1, [1.0, 0.0]), ("neg", 1, [-1.0, 0.0]), ("dim", 1, [1.0])], "id string, version long, embedding array<float>")
    assert [r.id for r in search.vector(m, e, [1.0, 0.0], 10).orderBy("rank").collect()] == ["up", "diag", "side", "neg"]


def test_bm25_ties_and_corpus(spark):
    m = mem(spark, [("a", 1, "rain", "w"), ("A", 1, "rain", "w"), ("z", 1, "rain", "w")])
    r = search.bm25(m, "rain", 10).orderBy("rank").collect()
    assert [x.id for x in r] == ["A", "a", "z"]
    assert search.bm25(m, "snow", 10).count() == 0
    assert search.bm25(m, "!!", 10).count() == 0
    later = mem(spark, [("a", 1, "rain", "w"), ("A", 1, "rain", "w"), ("z", 1, "rain", "w"), ("z", 2, "sun", "w")])
    assert search.bm25(later, "rain", 10).orderBy("rank").first().score > r[0].score


def test_merge(spark):
    s = "id string, version long"
    lex, sem = spark.createDataFrame([("b", 1), ("c", 2)], s), spark.createDataFrame([("b", 2), ("c", 2), ("a", 1)], s)
    got = [(r.id, r.version, r.origin) for r in search.merge(lex, sem, 2).orderBy("rank").collect()]
    assert got == [("a", 1, "semantic"), ("b", 2, "semantic")]
    assert search.merge(lex, None, 50).count() == 2


def test_eligibility_border(spark):
    now = dt.datetime(2024, 1, 2)
    o = spark.createDataFrame([("exact", "observation", "1", now - dt.timedelta(hours=24)), ("young", "observation", "2", now - dt.timedelta(hours=24) + dt.timedelta(microseconds=1)), ("same", "observation", "3", now - dt.timedelta(days=3))], "session_id string, event_type string, receipt_id string, ingested_at timestamp")
    l = spark.createDataFrame([("start", "session_start", "4", now - dt.timedelta(days=9)), ("end", "session_end", "5", now)], o.schema)
    rec = spark.createDataFrame([("same", 0, 1)], "session_id string, lifecycle_count long, observation_count long")
    assert sorted(r.session_id for r in session.eligible(l, o, rec, F.lit(now)).collect()) == ["end", "exact"]


def test_fingerprints_merge(spark):
    s = "session_id string, type string, title string, content string, concepts array<string>, receipts array<string>"
    g = spark.createDataFrame([("s", "t", " x ", "y", ["B", "a"], ["2"]), ("s", "t", "x", "y ", ["A ", "b"], ["1", "2"]), ("s", "t", "x", "z", [], ["3"])], s)
    got = session.candidates(g).orderBy("ordinal").collect()
    assert len(got) == 2 and ["1", "2"] in [r.receipts for r in got]


def test_uuid5(spark):
    ns = session.REVISION_NAMESPACE
    got = spark.range(1).select(T.uuid5(ns, F.lit("héllo")).alias("u")).first().u
    assert got == str(uuid.uuid5(uuid.UUID(ns), "héllo"))


def test_alias_keys():
    assert T.alias_key("  Straße  ﬁ ") == "strasse fi"
    assert T.alias_key(" ") is None and T.alias_key("a\x1cb") == "a\x1cb"


def test_timestamps(spark):
    rows = [("2024-01-01T00:00:00.000Z", True), ("2024-01-01t00:00:00.000z", True), ("2024-01-01T00:00:00.00Z", False), ("2024-01-01T00:00:00.0000Z", False), ("2024-02-30T00:00:00.000Z", False), ("2024-01-01T00:00:00.000+24:00", False), ("2024-01-01T00:00:00.000+23:59", True)]
    got = spark.createDataFrame(rows, "t string, ok boolean").select("t", (T.timestamp_ms(F.col("t")).isNotNull() == F.col("ok")).alias("same")).collect()
    assert all(r.same for r in got), got


def test_paths_work_bound(spark):
    a = spark.createDataFrame([("e1", "a", "uses", "b"), ("e2", "b", "uses", "c"), ("e3", "a", "related_to", "c")], "id string, subject string, relation string, object string")
    full = graph.find_paths(a, "a", "c", "outgoing", 3).orderBy("rank").collect()
    assert [(r.hops, r.concept_ids) for r in full] == [(1, "a>c"), (2, "a>b>c")] and full[0].work == 4
    assert [r.outcome for r in graph.find_paths(a, "a", "c", "outgoing", 3, max_work=3).collect()] == ["work_exhausted"]
    with pytest.raises(ValueError):
        graph.find_paths(a, "a", "a")


def test_chunks(spark):
    e = spark.createDataFrame([("s", 1, "k", "é" * 300), ("s", 2, "k", "x")], "session_id string, position long, kind string, content string")
    got = session.chunks(e, 200).orderBy("chunk").collect()
    assert all(len(r.json.encode()) <= 200 for r in got)
    parts = [p for r in got for p in json.loads(r.json)]
    assert "".join(p["content"] for p in parts if p["position"] == 1) == "é" * 300
    with pytest.raises(Exception, match="byte budget"):
        session.chunks(e, 20).collect()


def test_json_doubles(spark):
    df = spark.createDataFrame([('{"a":9007199254740993,"b":[1,true]}',), ('{"a":NaN}',), (None,)], "j string")
    assert [r.d for r in df.select(ledger.doubles(F.col("j")).alias("d")).collect()] == ['{"a":9007199254740992.0,"b":[1.0,true]}', None, None]


def test_stream_and_cli(spark, tmp_path):
    land = tmp_path / "in"
    land.mkdir()
    base = ["--landing", str(land), "--session-id", "s", "--project-name", "", "--cwd", "/w", "--timestamp", "2024-01-01T00:00:00.000Z"]
    assert cli.main(["session-start", *base]) == 0
    assert cli.main(["observation", *base, "--hook-type", "h"], io.StringIO('{"a":1}')) == 0
    assert cli.main(["observation", *base, "--hook-type", "h"], io.StringIO("[1]")) == 2
    assert cli.main(["session-start", *base[:-1], "yesterday"]) == 2
    assert cli.main(["session-start", "--landing", str(tmp_path / "none"), *base[2:]]) == 3
    (land / "bad.json").write_text('{"event_type":"observation"}\n')
    ledger_stream.start(spark, str(land), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    n = lambda t: spark.read.parquet(str(tmp_path / "out" / t)).count()
    assert (n("session_events"), n("raw_observations"), n("quarantine")) == (1, 1, 1)


def test_queue_rules(spark):
    e = spark.createDataFrame([("s", 1, "observation"), ("s", 2, "session_start"), ("s", 3, "session_end"), ("s", 4, "observation")], "session_id string, seq long, event_type string")
    assert [r.emitted for r in ledger.ordered_runtime(e).orderBy("seq", "ordinal").collect()] == ["session_start", "observation", "session_end"]


def test_evidence_rules(spark):
    a = spark.createDataFrame([("x",), ("y",)], "id string")
    s = spark.createDataFrame([(i,) for i in range(40)], "source_ref_id long")
    e = spark.createDataFrame([("x", i) for i in range(32)] + [("y", 1)], "assertion_id string, source_ref_id long")
    r = spark.createDataFrame([(1, "add", "x", 1), (2, "add", "x", 35), (9, "add", "y", 35), (4, "remove", "y", 1), (5, "remove", "x", 1), (6, "remove", "x", 39), (7, "add", "z", 1), (8, "add", "x", 99)], "ordinal long, op string, assertion_id string, source_ref_id long")
    got = {r.ordinal: r.outcome for r in graph.evidence_outcomes(a, s, e, r).collect()}
    assert got == {1: "existing", 2: "evidence_limit", 9: "created", 4: "would_orphan_evidence", 5: "deleted", 6: "missing_evidence", 7: "missing_assertion", 8: "missing_source"}


def test_evidence_is_served_in_order(spark):
    a = spark.createDataFrame([("x",), ("y",)], "id string")
    s = spark.createDataFrame([(i,) for i in range(50)], "source_ref_id long")
    e = spark.createDataFrame([("x", i) for i in range(31)] + [("y", 1), ("y", 2)], "assertion_id string, source_ref_id long")
    r = spark.createDataFrame([(1, "add", "x", 40), (2, "add", "x", 41), (3, "add", "x", 40), (4, "remove", "x", 40), (5, "add", "x", 41), (6, "remove", "y", 1), (7, "remove", "y", 2), (8, "remove", "y", 1)], "ordinal long, op string, assertion_id string, source_ref_id long")
    got = {r.ordinal: r.outcome for r in graph.evidence_outcomes(a, s, e, r).collect()}
    assert got == {1: "created", 2: "evidence_limit", 3: "existing", 4: "deleted", 5: "created", 6: "deleted", 7: "would_orphan_evidence", 8: "missing_evidence"}


def test_concepts_of_one_batch(spark):
    al = spark.createDataFrame([("c", "old", True)], "concept_id string, alias_key string, is_preferred boolean")
    r = [(1, "a", True), (2, "a", True), (3, "a", True), (3, "b", False), (4, "old", True), (5, "a", True), (5, "old", False), (6, "z", True)]
    got = {x.ordinal: x.outcome for x in graph_mutations.create_concepts(al, spark.createDataFrame(r, "ordinal long, key string, preferred boolean")).collect()}
    assert got == {1: "created", 2: "existing", 3: "alias_set_mismatch", 4: "existing", 5: "alias_owned", 6: "created"}


def test_mentions_of_one_batch(spark):
    c, s = spark.createDataFrame([("c",)], "id string"), spark.createDataFrame([(1,)], "source_ref_id long")
    m = spark.createDataFrame([], "concept_id string, source_ref_id long")
    r = spark.createDataFrame([(k, op, "c", 1) for k, op in enumerate(("delete", "create", "create", "delete", "delete"))], "ordinal long, op string, concept_id string, source_ref_id long")
    assert [x.outcome for x in graph.mention_outcomes(c, s, m, r).orderBy("ordinal").collect()] == ["missing_mention", "created", "existing", "deleted", "missing_mention"]


def test_end_of_an_unknown_session(spark):
    e = spark.createDataFrame([("s", 1, "session_end"), ("s", 2, "session_start"), ("s", 3, "session_end"), ("s", 4, "session_start")], "session_id string, seq long, event_type string")
    assert [(r.seq, r.emitted) for r in ledger.ordered_runtime(e).orderBy("seq").collect()] == [(2, "session_start"), (3, "session_end")]


def test_reduction_by_bytes(spark):
    rows = [("s", k, [f"sentence {k}"], [f"c{k}-{j}" for j in range(10)]) for k in range(9)] + [("t", 0, ["one"], [f"d{j}" for j in range(10)])]
    g = spark.createDataFrame(rows, "session_id string, chunk int, summary_sentences array<string>, concepts array<string>")
    budget = 500

    def reducer(payload):
        assert len(payload.encode()) <= budget
        items = json.loads(payload)
        return {"summary_sentences": [f"{len(items)} of {items[0]['summary_sentences'][0]}"[:40]], "concepts": items[0]["concepts"]}

    got = {r.session_id: r for r in session.reduce(g, reducer, budget).collect()}
    assert set(got) == {"s", "t"} and got["s"].concepts[0] == "c0-0" and got["t"].summary_sentences == ["1 of one"]
    for bad, why in ((100, "too small for one"), (200, "did not get shorter")):
        with pytest.raises(Exception, match=why):
            session.reduce(g, lambda p: {"summary_sentences": ["x"], "concepts": [str(j) for j in range(10)]}, bad).collect()
    with pytest.raises(Exception, match="10 different"):
        session.reduce(g, lambda p: {"summary_sentences": ["x"], "concepts": ["a"]}, 5000).collect()
