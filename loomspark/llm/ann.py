"""Operator 4: approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the largest inner product.  A block's vectors are split into ranges of like norm,
so that a long vector doesn't make the others look alike; in a range, unit vectors are hashed.
Ranges are met from the longest vectors on, and a query leaves out those whose norm is too
small for its k best.  A range is scanned exactly for the queries whose k-th score needs a
similarity below ``SURE`` there, or that have fewer than k, and if it is small: there hashing
would miss too many.

A table's hash is ``K`` functions floor((a x + b) / W) with Gaussian (2-stable) a.  A query
visits, in each of ``TABLES`` tables, its own bucket and then perturbed ones: functions are
ordered by how near the query lies to a border, and sets of perturbations are visited in the
order of their estimated success, which is found once from the expected border distances.
The candidates of all tables are merged and reranked by exact inner products in double
precision on the original vectors.

The index is made for blocks of about ``BLOCK`` vectors; blocks of queries meet blocks of
vectors, each pair in a task of its own with bounded memory, and give back the k best found;
the k best of all blocks follow by a partial aggregate of fixed size.  Random vectors have
no near neighbours to speak of (similarity 0.35 in 64 dimensions), so a recall of 0.9 takes
a fixed share of each block; ``PROBES`` and ``TABLES`` say which, whatever the input's size.

Defined results: vectors that are null, zero, of another length than the most frequent one,
or hold null or non-finite components take no part; repeated rows (equal vec_id and vector)
count once; a null vec_id takes no part; ties go to the smaller vec_id; a vec_id with several
vectors is a candidate by each of them and, as a query, has one list of the best of all; a query
has all candidates if there are fewer than asked for; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

K, W, TABLES, PROBES = 8, 1.5, 24, 150
BLOCK, QUERY_BLOCK, TOP = 8192, 512, 20
SEED = 7
#: Norms of a range differ by this factor at most; ranges of fewer vectors are scanned.
RANGE, LEAST_HASHED = 1.25, 512
#: Vectors of this similarity and more are visited with a probability of 0.9 and more.
SURE = 0.28


@lru_cache(4)
def perturbations(k: int, probes: int) -> tuple[tuple[tuple[int, ...], ...], ...]:
    """The first ``probes`` perturbation sets over 2k border distances in increasing order.

    A set may not move the same function both ways (places i and 2k - 1 - i).  Its estimated
    cost is the sum of the expected squared distances; sets come from a heap by cost.
    """
    z = [(j * (j + 1)) / (4 * (k + 1) * (k + 2)) if j <= k else 1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(1, 2 * k + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(z[0], (0,))]
    while heap and len(out) < probes:
        cost, s = heappop(heap)
        if all(2 * k - 1 - i not in s for i in s):
            out.append(s)
        last = s[-1]
        if last + 1 < 2 * k:
            heappush(heap, (cost - z[last] + z[last + 1], (*s[:-1], last + 1)))
            heappush(heap, (cost + z[last + 1], (*s, last + 1)))
    return tuple(out)


class Index:
    """p-stable hash tables over the rows of a matrix (already extended, see above)."""

    def __init__(self, x: np.ndarray, k: int = K, w: float = W, tables: int = TABLES, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.k, self.w = k, w
        self.a = rng.standard_normal((tables, x.shape[1], k))
        self.b = rng.uniform(0, w, (tables, k))
        self.mul = (rng.integers(1, 2**62, (tables, k)) * 2 + 1).astype(np.int64)
        self.tables = []
        for t in range(tables):
            cell = np.floor((x @ self.a[t] + self.b[t]) / w).astype(np.int64)
            key = (cell * self.mul[t]).sum(1)
            order = np.argsort(key, kind="stable")
            self.tables.append((key[order], order))

    def candidates(self, q: np.ndarray, probes: int = PROBES):
        """For every query the merged rows of all visited buckets."""
        sets = perturbations(self.k, probes)
        n = len(q)
        seen = np.zeros((n, len(self.tables[0][1])), bool)
        for t, (keys, order) in enumerate(self.tables):
            f = (q @ self.a[t] + self.b[t]) / self.w
            cell = np.floor(f)
            to_low = f - cell
            # places 0..k-1: lower borders, k..2k-1: upper borders, by distance
            dist = np.concatenate([to_low, 1 - to_low], axis=1)
            place = np.argsort(dist, axis=1, kind="stable")
            move = np.where(place < self.k, -1, 1) * self.mul[t][place % self.k]
            own = (cell.astype(np.int64) * self.mul[t]).sum(1)
            probe = np.stack([own + move[:, list(s)].sum(1) if s else own for s in sets], axis=1)
            lo, hi = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
            # all rows of all visited buckets at once: bucket starts plus running offsets
            who, _ = np.nonzero(hi > lo)
            size, first = (hi - lo)[hi > lo], lo[hi > lo]
            at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
            seen[np.repeat(who, size), order[at]] = True
        for row in seen:
            yield np.flatnonzero(row)


def _clean(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = vectors.select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & e.isNotNull())
    return df.filter(finite & F.exists(e, lambda x: x != 0))


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(pdf["embedding"].to_numpy()).astype("<f8")
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "rows": [x.tobytes()]})


def _lengths(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def _meet(dim: int, k: int, options: dict):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        ids, x = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["rows"], "<f8").reshape(-1, dim)
        qids, q = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_rows"], "<f8").reshape(-1, dim)
        lengths, asked = _lengths(x), _lengths(q)
        best = [(np.empty(0, np.int64), np.empty(0)) for _ in qids]

        def add(i: int, rows: np.ndarray) -> None:
            rows = rows[ids[rows] != qids[i]]
            score = x[rows] @ q[i]
            # the sum in fixed order, the same for every block and candidate
            if len(rows) > k:
                close = np.partition(score, len(score) - k)[len(score) - k]
                close -= 1e-9 * max(1.0, abs(close))
                rows, score = rows[score >= close], score[score >= close]
            exact = np.array([float(sum((x[j] * q[i]).tolist())) for j in rows])
            rows, exact = np.concatenate([best[i][0], rows]), np.concatenate([best[i][1], exact])
            order = np.lexsort((ids[rows], -exact))[:k]
            best[i] = rows[order], exact[order]

        def reach(i: int, norm: float) -> float:
            """The similarity that a vector of this norm needs to be among the best of a query."""
            return best[i][1][-1] / (asked[i] * norm) if len(best[i][0]) == k else -np.inf

        # from the longest vectors on: a range's bound rules out all that follows it
        level = np.floor((np.log(lengths.max()) - np.log(lengths)) / np.log(RANGE) + 1e-9).astype(np.int64)
        for part in np.unique(level):
            rows = np.flatnonzero(level == part)
            norm = lengths[rows].max()
            open_ = [i for i in range(len(qids)) if reach(i, norm) <= 1 + 1e-9]
            hashed = open_ if len(rows) >= LEAST_HASHED else []
            # queries that are known to need more than the hashing finds go the exact way at once
            hashed = [i for i in hashed if len(best[i][0]) < k or reach(i, norm) >= SURE]
            if hashed:
                index = Index(x[rows] / lengths[rows, None], options["k"], options["w"], options["tables"], options["seed"])
                saved = {i: best[i] for i in hashed}
                for i, found in zip(hashed, index.candidates(q[hashed] / asked[hashed, None], options["probes"]), strict=True):
                    add(i, rows[found])
                again = [i for i in hashed if reach(i, norm) < SURE]
                for i in again:
                    best[i] = saved[i]
            else:
                again = []
            for i in again + [i for i in open_ if i not in set(hashed)]:
                add(i, rows)
        out = [(int(qids[i]), int(ids[j]), float(s)) for i, (rows, score) in enumerate(best) for j, s in zip(rows, score, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, block: int = BLOCK, query_block: int = QUERY_BLOCK, k: int = K, w: float = W, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found for each query vector.

    Both tables have vec_id and embedding; a query's own vec_id is no candidate.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    clean = materialise(_clean(vectors).dropDuplicates(["vec_id", "embedding"]), "vectors")
    dims = clean.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = dims.orderBy(F.col("n").desc(), "d").first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = first["d"], first["n"]
    clean = clean.filter(F.size("embedding") == dim)
    asked = _clean(queries).filter(F.size("embedding") == dim).dropDuplicates(["vec_id", "embedding"])
    # a table of its own for the queries: their number decides on their blocks
    asked = materialise(asked, "queries")
    n_q = asked.count()
    blocks, q_blocks = -(-n // block), max(1, -(-n_q // query_block))
    packed = lambda df, m: df.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")).groupBy("block").applyInPandas(_pack, "block int, ids binary, rows binary")
    xs = materialise(packed(clean, blocks), "blocks")
    qs = materialise(packed(asked, q_blocks).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows")), "blocks")
    meetings = qs.select("q_block", "q_ids", "q_rows", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("of")).join(xs, F.col("of") == F.col("block"))
    options = {"k": k, "w": w, "tables": tables, "probes": probes, "seed": seed}
    found = meetings.select("q_block", "block", "ids", "rows", "q_ids", "q_rows").groupBy("q_block", "block").applyInPandas(_meet(dim, top, options), schema)
    best = F.struct((-F.col("score")).alias("minus"), "vec_id", "score")
    # every block gives at most ``top`` a query
    per = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(best)), 1, top).alias("best"))
    return per.select("query_id", F.posexplode("best").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op4_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
