"""Operator 5: quality rules as weak supervision.

Each rule looks at a document's counts and votes good, bad or abstains.  Rules differ in how
often they are right, so instead of an all-must-pass filter an expectation-maximisation
estimates, without labels, the share of good documents and, for each rule and class, how
often it gives each vote.  A document's posterior probability of being good decides.

Scale: one pass over the texts makes a few numbers a document, stored in the shared folder.
The EM runs on the counts of vote patterns, at most 3 ^ rules rows whatever the corpus; so
does the posterior.  No shuffle holds text.

Defined results: null and blank texts have no words and fail the base rule; repeated rows are
kept; an empty table gives no rows; a very long text is measured whole, in one pass; a posterior
of exactly 0.5 keeps the text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table
from .neardup import _mix, _words

SYMBOLS = "#*$%&|<>"
#: Frequent words of English, French, German and Spanish.
COMMON = frozenset(b"the of and to in is that for on with are de la le les et des est en un une der die das und ist nicht von mit zu el los las que y una por con".split())
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters, n_common, n_ends."""
    if not text:
        return (0,) * 10
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    repeat = 0
    if n >= 3:
        h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
        w = _mix((h[:-2] * _GOLD + h[1:-1]) * _GOLD + h[2:])
        order = np.argsort(w)
        same = w[order[1:]] == w[order[:-1]]
        if same.any():
            twice = np.zeros(n, bool)
            at = np.concatenate([order[1:][same], order[:-1][same]])
            for k in range(3):
                twice[at + k] = True
            repeat = int(twice.sum())
    letters = _letters(raw)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    common = sum(map(COMMON.__contains__, words))
    ends = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
    return (n, len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines), upper, letters, common, ends)


def _letters(raw: bytes) -> int:
    """Letters, as str.isalpha has them; only characters beyond ASCII are looked at one by one."""
    plain = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    return plain + sum(map(str.isalpha, raw.translate(None, bytes(range(128))).decode("utf-8", "surrogatepass")))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_common", "n_ends")


def measures(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(None if i != i else i, *measure(t)) for i, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", *FIELDS], dtype=object)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, " + ", ".join(f"{x} long" for x in FIELDS))


def _vote(bad, good):
    return F.when(bad, 0).when(good, 2).otherwise(1)


def rules() -> dict:
    """Rule -> vote column: 0 bad, 1 abstains, 2 good."""
    c, w = F.col, F.greatest(F.col("n_words"), F.lit(1))
    mean = c("word_chars") / w
    shout = c("n_upper") / F.greatest(c("n_letters"), F.lit(1))
    return {
        "length": _vote(c("n_words") < 20, c("n_words") >= 80),
        "repeats": _vote(c("n_repeat_words") > 0.3 * w, c("n_repeat_words") <= 0.1 * w),
        "symbols": _vote(c("n_symbols") > 0.1 * w, c("n_symbols") <= 0.01 * w),
        "dup_lines": _vote(c("n_dup_lines") > 0.3 * F.greatest(c("n_lines"), F.lit(1)), c("n_dup_lines") == 0),
        "word_length": _vote((mean < 3) | (mean > 10), (mean >= 3.5) & (mean <= 8)),
        "shouting": _vote(shout > 0.4, shout < 0.15),
        "common_words": _vote(c("n_common") < 0.03 * w, c("n_common") >= 0.1 * w),
        "letters": _vote(c("n_letters") < 0.7 * c("word_chars"), c("n_letters") >= 0.9 * c("word_chars")),
        "sentences": _vote(c("n_ends") * 80 < c("n_words"), c("n_ends") * 40 >= c("n_words")),
    }


def expectation_maximisation(votes: np.ndarray, count: np.ndarray, steps: int = 200) -> np.ndarray:
    """Posterior probability of good for each vote pattern (rows of 0, 1, 2)."""
    n, r = votes.shape
    lean = (votes == 2).sum(1) - 1.5 * (votes == 0).sum(1)
    post = 1 / (1 + np.exp(-lean))
    hot = np.stack([(votes == v) for v in range(3)], axis=2).astype(float)  # pattern, rule, vote
    # a rule's votes are taken to be right more often than not: weak pseudo-counts
    good0, bad0 = np.array([1.0, 2.0, 3.0]), np.array([3.0, 2.0, 1.0])
    for _ in range(steps):
        g, b = post * count, (1 - post) * count
        tg = np.einsum("p,prv->rv", g, hot) + good0
        tb = np.einsum("p,prv->rv", b, hot) + bad0
        tg, tb = tg / tg.sum(1, keepdims=True), tb / tb.sum(1, keepdims=True)
        share = (g.sum() + 1) / (count.sum() + 2)
        z = np.log(share / (1 - share)) + np.einsum("prv,rv->p", hot, np.log(tg) - np.log(tb))
        new = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, p_good, kept for every row."""
    r = rules()
    pattern = sum(((v * 3**k) for k, v in enumerate(r.values())), F.lit(0)).cast("int")
    counted = materialise(measures(docs).withColumn("pattern", pattern), "measures")
    seen = counted.groupBy("pattern").count().toPandas().sort_values("pattern")  # at most 3 ^ rules rows
    chance = [0.5] * 3 ** len(r)
    if len(seen):
        votes = np.stack([seen["pattern"].to_numpy() // 3**k % 3 for k in range(len(r))], axis=1)
        for p, x in zip(seen["pattern"], expectation_maximisation(votes, seen["count"].to_numpy(float)), strict=True):
            chance[p] = float(x)
    known = docs.sparkSession.createDataFrame([(int(p), chance[p]) for p in seen["pattern"]], "p int, p_good double")
    out = counted.join(F.broadcast(known), F.col("pattern") == F.col("p"))  # bounded like ``seen``
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("p_good") >= 0.5)).alias("kept"), "p_good")


def op5_quality(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))
