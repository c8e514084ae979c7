"""Line dedup against brute force: every repeated run of whole lines goes."""

import random

from loomspark.llm import linededup

from test_operators import words


def repeated(held, least=linededup.MIN_WORDS):
    """{doc: line numbers} of all runs of ``least`` words or more that stand at an earlier place."""
    out = {i: set() for i in held}
    places = [(i, p) for i in sorted(held) for p in range(len(held[i][0]))]
    for k, (i, p) in enumerate(places):
        for j, q in places[:k]:
            (h, n), (g, _) = held[i], held[j]
            if p and q and h[p - 1] == g[q - 1]:
                continue  # not the start of a maximal run
            e = 0
            while p + e < len(h) and q + e < len(g) and h[p + e] == g[q + e]:
                e += 1
            if sum(n[p : p + e]) >= least:
                out[i] |= set(range(p, p + e))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = {x.doc_id: x for x in linededup.line_table(df).collect()}
    runs = {x.doc_id: x.runs for x in linededup.repeated_runs(df).collect()}
    got = {i: {k for k, a in enumerate(x.at) if any(r.a <= a < r.b for r in runs.get(i, []))} for i, x in lines.items()}
    want = repeated({i: (x.h, x.n) for i, x in lines.items()})
    assert got == want
    return got


def test_run_whose_parts_stand_earlier(spark):
    """Each part of a passage, and so each fingerprint, stands in an earlier short match."""
    lines = [" ".join(words(10, 700 + k)) + "." for k in range(8)]
    rows = [(k, f"one{k} two. " + " ".join(lines[k : k + 2]) + f" end{k}.") for k in range(7)]
    rows += [(20 + k, f"one{k} two. " + " ".join(lines[k : k + 2]) + f" end{k}.") for k in range(7)]
    rows += [(10, " ".join(lines)), (30, "start here. " + " ".join(lines) + " stop.")]
    got = check(spark, rows)
    assert got[30] == set(range(1, 9)) and not any(got[k] for k in got if k < 30)


def test_repeats_inside_a_document(spark):
    line = " ".join(words(4, 800))
    got = check(spark, [(0, "\n".join([line] * 4)), (1, "\n\n".join([line] * 40))])
    assert got[1] == set(range(1, 40))


def test_all_runs_against_brute_force(spark):
    r = random.Random(8)
    pool = [" ".join(words(n, 900 + k)) for k, n in enumerate((1, 2, 5, 9, 16, 40))]
    got = check(spark, [(i, r.choice(("\n", "\n\n")).join(r.choice(pool) for _ in range(r.randrange(0, 25)))) for i in range(30)])
    assert sum(map(len, got.values())) > 50


def test_weights_are_words(spark):
    """Cells between tabs are words, and so a repeated table goes; runs of spaces are one gap."""
    table = "\n".join("\t".join(words(10, 1000 + k)) for k in range(20))
    rows = [(0, "first title\n" + table), (1, "other title\n" + table), (2, "a  b \t c\x0bd\fe\r\nf g   h. I  j")]
    lines = {x.doc_id: x.n for x in linededup.line_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert lines == {0: [2] + [10] * 20, 1: [2] + [10] * 20, 2: [5, 3, 2]}
    assert check(spark, rows)[1] == set(range(1, 21))
