"""op11 against a search over all edit sequences, and awkward rows."""

import hashlib
import heapq
import random
import re
import zlib

from loomspark.llm import conversations
from loomspark.llm.conversations import Repair

_GRAMMAR = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def _brute(rows):
    """Cheapest edits by Dijkstra over (rows used, roles so far), strings compared whole."""
    heap, seen, best = [(0, "", 0, "", ())], {}, None
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if i == len(rows) and _GRAMMAR.fullmatch(roles):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, out)
            continue
        if seen.setdefault((i, roles, len(audit)), (cost, audit)) < (cost, audit) or not re.fullmatch(r"s?(ua)*u?", roles) or len(roles) > 2 * len(rows) + 2:
            continue
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + (role[:1] or "?"), (*out, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, roles + r[0], (*out, f"{r}:{text}")))
        for r in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + r[0], (*out, f"{r}:")))
    return best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def _plain(rows):
    """The whole contract in plain Python, rows: (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = convs.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        mine += [(turn is not None, turn or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort()
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault))
        turns = [t for given, t, _, _ in mine if given]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts.values(), illegal, *_brute(judged))
    return out


def test_cheapest_edits_equal_search():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), f"t{i}.", rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for i in range(rng.randint(0, 7))]
        work = Repair()
        for i, row in enumerate(rows):
            work.add(i, *row)
        got = work.result()
        assert (got["cost"], got["audit"], got["repaired_sha256"]) == _brute(rows), rows


def test_long_conversations_stream():
    """Flushed decisions equal those of one layer carried whole, and the open part stays short."""
    rng, rows = random.Random(6), []
    for i in range(5000):
        rows.append((rng.choice(["user", "assistant", "assistant", "user", "system"]), f"x{i}", rng.choice(["", "", "blank", "truncated"])))
    work, whole, longest = Repair(), Repair(), 0
    whole._decide = lambda said: None
    for i, row in enumerate(rows):
        work.add(i, *row)
        whole.add(i, *row)
        longest = max(longest, len(work.open))
    del whole._decide
    assert work.result() == whole.result()
    assert longest < 500


def test_query_equals_plain(spark, tmp_path):
    rng, rows = random.Random(7), []
    texts = ["Yes.", "No", "", "  ", None, "Why?", "a. b. c", "end.\n", "end . ", "Yes.", "x" * 20000 + "!"]
    for conv in [*range(60), None]:
        for turn in [*range(rng.randint(1, 6)), *([None] * rng.randint(0, 2)), *([3] * rng.randint(0, 1))]:
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "tool", None, ""]), rng.choice(texts)))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.selectExpr("*", "1 as copy", "'x' as fault", "2 as nth", "true as dropped").write.parquet(f"{tmp_path}/conversations.parquet")
    got = conversations.op11_conversations(spark, str(tmp_path)).collect()
    want = _plain(rows)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_nothing_left(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "a")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in conversations.op11_conversations(spark, str(tmp_path)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    none = spark.read.parquet(f"{tmp_path}/conversations.parquet").filter("false")
    assert conversations.repair(conversations.damaged(none)).count() == 0
