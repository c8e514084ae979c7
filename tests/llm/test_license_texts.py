"""Licence scans: whole texts, wrapped notices, and brute force over canonical forms."""

import hashlib
import random
import re
import textwrap

from loomspark.llm import licenses

TEXTS = [t for _, t in licenses.LICENSES]


def spelled(t):
    c = re.sub(licenses.COPYRIGHT_LINE, " ", (t or "").lower())
    for a, b in licenses.SPELLINGS:
        c = c.replace(a, b)
    return re.sub(r"[^\w\n]+", " ", c.replace("_", " "))


def flat(c):
    return " ".join(c.split())


def untitled(c):
    lines = c.split("\n")
    while lines and (not lines[0].strip() or lines[0].strip() in licenses.TITLES) and any(x.strip() in licenses.TITLES for x in lines[: next((k + 1 for k, x in enumerate(lines) if x.strip()), 0)]):
        lines.pop(0)
    return "\n".join(lines)


def brute(t, known, most):
    whole = flat(untitled(spelled(t)))
    lines = [flat(x) for x in spelled(t).split("\n")]
    hits = [known[x] for x in lines if x in known]
    parts = re.split(r"\n ?(?:\n ?)+", spelled(t))
    parts = [p for p in parts if flat(p)]
    for k in range(1, most + 1):
        for i in range(len(parts) - k + 1):
            run = "\n".join(parts[i : i + k])
            if "\n" in run.strip() and flat(run) in known:
                hits.append(known[flat(run)])
    return (hashlib.sha256(whole.encode()).hexdigest() if whole else None, known.get(whole), ",".join(sorted(set(hits))), len(hits))


def test_against_brute_force(spark):
    r = random.Random(9)
    rows = ["", None, "(c) 2020 me", "\n\n", "x" * 300_000]
    for t in TEXTS:
        wrapped = "\n\n".join(textwrap.fill(p, 50, break_on_hyphens=False) for p in t.split("\n\n"))
        rows += [t, wrapped, f"MIT License\n\nCopyright (c) 2021 Somebody\n\n{wrapped}", f"some words before\n\n{wrapped}\n\nand after", t.upper().replace("LICENSE", "LICENCE"), f"{t}\n{t}"]
    for _ in range(30):
        rows.append(r.choice(("\n", "\n\n", " ")).join(r.choice(TEXTS[:2] + ["All rights reserved.", "# Copyright 1999", "other words", "MIT License", ""]) for _ in range(r.randrange(1, 9))))
    known = {}
    for i, t in sorted(licenses.LICENSES, reverse=True):
        known[flat(untitled(spelled(t)))] = i
    most = max(t.count("\n\n") + 1 for t in TEXTS)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("*", "1 as digest", "2 as license_id", "3 as pieces")
    got = {x.doc_id: (x.digest, x.license_id, x.notice_ids, x.n_notices) for x in licenses.scan(df, licenses.known_digests(spark)).collect()}
    for i, t in enumerate(rows):
        assert got[i] == brute(t, known, most), (i, t)
    first = [got[5 + 6 * k] for k in range(len(TEXTS))]
    assert all(x[1] for x in first)
    assert not [(k, j) for k in range(len(TEXTS)) for j in (1, 2, 4) if not got[5 + 6 * k + j][1]]
    assert all(got[5 + 6 * k + j][1] for k in range(len(TEXTS)) for j in (1, 2, 4))
    assert all(got[5 + 6 * k + 3][3] >= 1 for k in range(len(TEXTS)))
    assert licenses.scan(df.limit(0), licenses.known_digests(spark)).count() == 0
