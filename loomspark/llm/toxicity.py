"""Operator 1: toxicity by maximum-scoring segment search.

Training, on labelled documents whose crc32(doc_id) mod 5 is not 0:

1. Per class, the number of documents with each token, and with each beginning of 4 to 6
   letters, by bucket (2^20 buckets, so the model's size is fixed whatever the vocabulary),
   summed over all training rows.  A token scores as the best of its buckets.
2. A token's score is its log-odds ratio between the classes with an informative Dirichlet
   prior (the corpus' own frequencies), shrunk towards 0 by two standard deviations, less a
   constant that makes a clean text's expected score negative.
3. Karlin-Altschul statistics: lambda solves E[exp(lambda * s)] = 1 over clean tokens; K is
   fitted to the best segments of the clean training documents.

Scoring: one linear scan per text finds every maximal scoring segment (Ruzzo-Tompa).  A
segment of score S among n tokens has log E-value ln(K n) - lambda S; a document's evidence
is the sum of -ln E over its segments with E < 1.  A logistic curve fitted on the training
rows' evidence (a histogram of fixed size) gives the score, so 0.5 means even odds.

Scale: the model is fitted on at most about ``TRAIN_ROWS`` labelled documents, taken by a hash
of doc_id; only their ids are broadcast, and only their texts are written once.  Counts leave a
task as packed blocks of ``SLICE`` buckets and are summed block by block, so that the driver gets
BUCKETS / SLICE rows of a fixed size.  All other texts are read once, by the scan, and never
shuffled; scoring and rejecting need no join.

Defined results: null and empty texts have no segment and get the score of no evidence;
labels other than 0 and 1 are ignored; a doc_id labelled both ways counts as toxic;
repeated rows are kept; rows that share a doc_id are scored and rejected each by its own text;
a tie (a score of exactly 0.5) counts as toxic; a very long text is one linear scan; without
training rows of both kinds every score is 0; an empty table gives no rows; other columns are
ignored (``score``) or passed through (``reject_toxic``).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import compress, crc32, decompress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

BUCKETS = 1 << 20
PRIOR = 5_000.0
SHRINK = 2.0
PENALTY = 0.25
BINS = 400
#: Most labelled documents used for fitting (as expected by their hash).
TRAIN_ROWS = 60_000
#: Buckets of a block of counts.
SLICE = 1024
TOKEN = re.compile(r"[^\W\d_]+")


STEMS = (4, 5, 6)


def buckets(token: str) -> list[int]:
    """Buckets of a token and of its first letters (inflected words share these)."""
    t = token.encode("utf-8", "surrogatepass")
    out = [crc32(t) % BUCKETS]
    for k in STEMS:
        if len(token) < k:
            break
        out.append(crc32(token[:k].encode("utf-8", "surrogatepass"), k) % BUCKETS)
    return out


class _Scores(dict):
    """Token -> the largest score among its buckets."""

    def __init__(self, scores: np.ndarray) -> None:
        super().__init__()
        self.scores = scores.tolist()

    def __missing__(self, token: str) -> float:
        if len(self) > 400_000:
            self.clear()
        v = self[token] = max(map(self.scores.__getitem__, buckets(token)))
        return v


def tokens(text: str | None) -> list[str]:
    """The lower-case tokens (runs of letters) of a text."""
    return TOKEN.findall(text.lower()) if text else []


def held_out(doc_id):
    """crc32(doc_id as text) mod 5 = 0; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, BUCKETS), np.int32)
    for pdf in batches:
        held = Counter(), Counter()
        for t, y in zip(pdf["text"].tolist(), pdf["toxic"].tolist(), strict=True):
            held[int(y)].update(set(tokens(t)))
        for y in (0, 1):
            at = [buckets(w) for w in held[y]]
            n = np.repeat(np.fromiter(held[y].values(), np.int32, len(at)), np.fromiter(map(len, at), np.int32, len(at)))
            np.add.at(counts[y], np.fromiter(chain.from_iterable(at), np.int32, len(n)), n)
    counts = counts.reshape(2, -1, SLICE).swapaxes(0, 1)
    for k in np.flatnonzero(counts.any(axis=(1, 2))).tolist():
        yield pd.DataFrame({"block": [k], "counts": [compress(counts[k].astype("<i4").tobytes(), 1)]})


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(2 * SLICE, "<i8")
    for x in pdf["counts"]:
        total += np.frombuffer(decompress(x), "<i4")
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [total.tobytes()]})


def log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Shrunk log-odds of toxic against clean per bucket, Dirichlet prior of ``PRIOR`` tokens."""
    n0, n1 = n0.astype(float), n1.astype(float)
    prior = PRIOR * (n0 + n1 + 0.01) / (n0 + n1 + 0.01).sum()
    a1, a0 = n1 + prior, n0 + prior
    odds = np.log(a1 / (a1.sum() - a1)) - np.log(a0 / (a0.sum() - a0))
    spread = np.sqrt(1 / a1 + 1 / a0)
    return np.sign(odds) * np.maximum(0, np.abs(odds) - SHRINK * spread)


def karlin_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p * exp(x * s)) = 1, for a negative mean score."""
    p = weights / weights.sum()
    if not (p[scores > 0] > 0).any():
        return 1.0
    low, high = 0.0, 1e-3
    f = lambda x: float((p * np.exp(np.minimum(x * scores, 700))).sum())
    while f(high) < 1 and high < 1e3:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 1 else (low, mid)
    return (low + high) / 2


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a score sequence, in linear time."""
    ends = np.cumsum(s)
    # candidates: start, end, sum before, sum at the end, and the nearest earlier candidate
    # with a lower sum before (-1: none); following these keeps the scan linear
    stack: list[list] = []
    for k in np.flatnonzero(s > 0).tolist():
        r = float(ends[k])
        start, low = k, r - float(s[k])
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= r:
                stack.append([start, k + 1, low, r, j])
                break
            start, low, above = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = above
    return [(a, b, r - lo) for a, b, lo, r, _ in stack]


class Model:
    """Bucket scores and the constants of the calibration; travels to the workers."""

    def __init__(self, scores: np.ndarray, lam: float, k: float = 1.0, curve: tuple[float, float] | None = None) -> None:
        self.scores, self.lam, self.k, self.curve = scores, lam, k, curve

    def log_e(self, n: int, score: float) -> float:
        """Log of the expected number of segments so good by chance among ``n`` tokens."""
        return math.log(self.k * n) - self.lam * score

    def feature(self, evidence: float) -> float:
        # squared-root scale: a few histogram cells hold any range of evidence
        return min(math.sqrt(evidence), BINS / 20)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-(self.curve[0] + self.curve[1] * self.feature(evidence)))) if self.curve else 0.0


def _best(of: _Scores, x: list[str]) -> list[tuple[int, int, float]]:
    return segments(np.fromiter(map(of.__getitem__, x), float, len(x))) if x else []


def _fit_scan(shared):
    """Of the training texts: label, tokens, and the scores of the segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = _Scores(shared.value.scores)
        for pdf in batches:
            found = [(int(y), len(x := tokens(t)), [v for _, _, v in _best(of, x)]) for y, t in zip(pdf["toxic"].tolist(), pdf["text"].tolist(), strict=True)]
            yield pd.DataFrame(found, columns=["toxic", "n_tokens", "seg"], dtype=object)

    return run


#: What the scan gives for a text.
SCANNED = "score double, n_tokens long, evidence double, seg_from array<int>, seg_to array<int>, seg_e array<double>"


def _scan(shared):
    @F.pandas_udf(SCANNED)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        of = _Scores(model.scores)
        for batch in texts:
            rows = []
            for t in batch.tolist():
                x = tokens(t)
                found = [(a, b, e) for a, b, v in _best(of, x) if (e := model.log_e(len(x), v)) < 0]
                evidence = -math.fsum(e for _, _, e in found)
                rows.append((model.score(evidence), len(x), evidence, [int(f[0]) for f in found], [int(f[1]) for f in found], [float(f[2]) for f in found]))
            yield pd.DataFrame(rows, columns=["score", "n_tokens", "evidence", "seg_from", "seg_to", "seg_e"])

    return run


def fit_logistic(x: np.ndarray, y1: np.ndarray, y0: np.ndarray) -> tuple[float, float]:
    """(intercept, slope) of a ridge-damped logistic curve on weighted points, by Newton steps."""
    a, b = math.log((y1.sum() + 0.5) / (y0.sum() + 0.5)), 0.0
    n = y1 + y0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))
        g = np.array([(y1 - n * p).sum(), ((y1 - n * p) * x).sum() - 1e-3 * b])
        w = n * p * (1 - p)
        h = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        d = np.clip(d, -1, 1)
        a, b = a + d[0], b + d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(a), float(max(b, 0.0))


def training_labels(labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(l_doc, toxic) of the rows to learn from: about ``most`` at most, by a hash of doc_id."""
    marks = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_doc")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.filter(~held_out(F.col("l_doc")))
    n = marks.count()
    return marks if n <= most else marks.filter(F.pmod(F.xxhash64("l_doc"), F.lit(1 << 20)) < int((1 << 20) * most / n))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """The model learnt from the labelled rows of ``docs`` that are not held out."""
    marks = F.broadcast(training_labels(labels, most))  # of a bounded size
    train = docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null")
    train = materialise(train.join(marks, F.col("doc_id") == F.col("l_doc")).select("text", "toxic"), "train")
    counted = train.mapInPandas(_count, "block int, counts binary").groupBy("block").applyInPandas(_add, "block int, counts binary")
    n = np.zeros((BUCKETS // SLICE, 2, SLICE), np.int64)
    for r in counted.collect():  # BUCKETS / SLICE rows at most
        n[r["block"]] = np.frombuffer(r["counts"], "<i8").reshape(2, SLICE)
    n0, n1 = n[:, 0].ravel(), n[:, 1].ravel()
    if not (n0.any() and n1.any()):
        return Model(np.full(BUCKETS, -PENALTY, np.float32), 1.0)
    s = log_odds(n0, n1)
    s = s - (PENALTY + max(0.0, float((s * n0).sum() / n0.sum())))
    model = Model(s.astype(np.float32), karlin_lambda(s, n0 + 1e-9))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = materialise(train.mapInPandas(_fit_scan(shared), "toxic int, n_tokens long, seg array<double>"), "segments")
    shared.unpersist()
    # the extreme-value law P(best <= x) = exp(-K n exp(-lambda x)) gives K from clean documents
    lam, best = F.lit(model.lam), F.coalesce(F.array_max("seg"), F.lit(0.0))
    row = found.filter("toxic = 0 and n_tokens > 0").agg(F.count(F.lit(1)).alias("d"), F.sum(F.col("n_tokens") * F.exp(-lam * best)).alias("m")).first()
    model.k = max(row["d"], 1) / row["m"] if row["m"] else 1.0
    log_e = lambda x: F.log(F.lit(model.k) * F.col("n_tokens")) - lam * x
    evidence = F.aggregate("seg", F.lit(0.0), lambda acc, x: acc + F.greatest(F.lit(0.0), -log_e(x)))
    cell = F.least(F.floor(F.sqrt(F.coalesce(evidence, F.lit(0.0))) * 20), F.lit(BINS - 1)).cast("int")
    hist = np.array([(r["cell"], r["y1"], r["n"]) for r in found.groupBy(cell.alias("cell")).agg(F.sum("toxic").alias("y1"), F.count(F.lit(1)).alias("n")).collect()], float)
    model.curve = fit_logistic((hist[:, 0] + 0.5) / 20, hist[:, 1], hist[:, 2] - hist[:, 1])
    return model


def score(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_tokens, evidence, segments for every row of ``docs``.

    ``segments`` holds (from, to, log_e) in tokens, for the segments with E < 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    x = docs.select(F.col("doc_id").cast("long"), _scan(shared)("text").alias("x")).select("doc_id", "x.*")
    parts = F.zip_with(F.arrays_zip("seg_from", "seg_to"), "seg_e", lambda s, e: F.struct(s["seg_from"].alias("from"), s["seg_to"].alias("to"), e.alias("log_e")))
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_tokens", "evidence", parts.alias("segments"))


def reject_toxic(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without the rows that :func:`score` predicts toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    name = next(c for k in range(len(docs.columns) + 1) if (c := f"__scanned{k}") not in docs.columns)
    return docs.withColumn(name, _scan(shared)("text")).filter(F.col(name)["score"] < 0.5).select(*docs.columns)


def op1_toxicity(spark, sf_dir):
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_tokens", F.size("segments").alias("n_segments"))
