"""Operator 2: near-duplicate classes by b-bit MinHash.

1. One pass over the texts makes, per document, the set of its distinct 5-word shingles (as
   64-bit hashes) and from it: the size, a 128-bit digest of the whole set, ``N_HASH`` minima,
   ``BANDS`` band hashes of ``ROWS`` full minima each, and the signature: the low two bits of
   every minimum, packed into bit planes.
2. Documents with equal sets are one class, held by its smallest doc_id; only classes go on.
   That is where thousands of exact copies become one row.
3. Band hashes group classes.  A group is not expanded into its pairs.  First each group's
   smallest class, its pivot, is paired with the others; the pair's similarity is estimated
   by bit counts of the XORed planes, corrected for chance collisions; pairs far below the
   threshold go and the others are confirmed on their full texts.  These links make the first
   components.  A link still untested matters only if it joins two components of one group.
   So in groups that hold several, the members outside the largest one meet the members of
   other components, in blocks of at most ``BLOCK`` by ``BLOCK`` texts: a block counts shared
   shingles through a sorted index, and gives back only links that join components.
4. Components are found by contraction: every node follows its least neighbour in an order
   that a fresh hash gives each round; equal ends merge, until no edge is left.

With b = 2 and 128 minima the estimate's standard deviation at similarity 0.85 is 0.037; the
margin is five of these.  A pair at 0.85 shares no band of 5 with probability 8e-6;
the pipeline, at 0.80, takes 32 bands of 4: 5e-8.

Scale: the text is read once, plus once for the classes that share a group.  All tables in
between are rows of a few integers in the shared folder.

Defined results: null and blank texts have an empty set and are linked with nothing;
repeated rows are copies; with fewer words than five the whole sequence is the one shingle;
a null doc_id links with nothing (component and kept null); texts whose class has the same
smallest doc_id are one node; a very long text is one set, in memory by itself; an empty
table gives no rows; a similarity of exactly the threshold links; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, table

N_HASH, ROWS, BANDS, SHINGLE = 128, 5, 20, 5
#: Defaults, which go with ROWS and BANDS; a lower threshold needs shorter bands.
LINK_PERCENT = 85
MARGIN = 0.20
BLOCK = 400
_P = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> 64-bit hash, forgotten when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _codes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's 5-word shingles."""
    w = _codes(text)
    if not len(w):
        return w
    k = min(SHINGLE, len(w))
    x = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        x = x * _P + w[i : len(w) - k + 1 + i]
    return np.unique(_mix(x))


_SEEDS = _mix(np.arange(1, N_HASH + 1, dtype=np.uint64) * _P)
_ODD = _mix(_SEEDS) | np.uint64(1)


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, N_HASH) minima of non-empty sets."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    x = np.concatenate(sets)
    out = np.empty((len(sets), N_HASH), np.uint64)
    for i in range(N_HASH):
        out[:, i] = np.minimum.reduceat((x ^ _SEEDS[i]) * _ODD[i], starts)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _signatures(ids: list, marks: list, sets: list[np.ndarray], n_bands: int = BANDS, n_rows: int = ROWS) -> pd.DataFrame:
    full = [s for s in sets if len(s)]
    bands, sigs, keys = iter(()), iter(()), iter(())
    if full:
        m = _minima(full)
        b = np.zeros((len(full), n_bands), np.uint64)
        for r in range(n_rows):
            b = b * _P + m[:, r : n_rows * n_bands : n_rows]
        b = _mix(b + np.arange(n_bands, dtype=np.uint64) * _P)
        low = _mix(m)
        planes = [np.packbits((low >> np.uint64(k) & np.uint64(1)).astype(np.uint8), axis=1).view(">u8").astype(np.uint64) for k in (0, 1)]
        bands, sigs = iter(_signed(b)), iter(_signed(np.concatenate(planes, axis=1)))
        keys = ((int(_signed(_mix(s).sum(keepdims=True))[0]), int(_signed(np.bitwise_xor.reduce(_mix(s * _P), keepdims=True))[0])) for s in full)
    rows = []
    for i, m, s in zip(ids, marks, sets, strict=True):
        if len(s):
            rows.append((i, m, len(s), *next(keys), next(bands), next(sigs)))
        else:
            rows.append((i, m, 0, None, None, None, None))
    return pd.DataFrame(rows, columns=["doc_id", "mark", "n_shingles", "k1", "k2", "bands", "sig"], dtype=object)


def _sign(n_bands: int, n_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, marks, sets, held = [], [], [], 0
            for i, m, t in zip(pdf["doc_id"].tolist(), pdf["mark"].tolist(), pdf["text"].tolist(), strict=True):
                s = shingles(t)
                ids.append(None if i != i else i)
                marks.append(m)
                sets.append(s)
                held += len(s)
                if held > 200_000 or len(ids) >= 2000:
                    yield _signatures(ids, marks, sets, n_bands, n_rows)
                    ids, marks, sets, held = [], [], [], 0
            if ids:
                yield _signatures(ids, marks, sets, n_bands, n_rows)

    return run


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    if bands * rows > N_HASH:
        raise ValueError(f"bands * rows must be {N_HASH} at most")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text").mapInPandas(_sign(bands, rows), "doc_id long, mark long, n_shingles long, k1 long, k2 long, bands array<long>, sig array<long>")


def estimate(a: str, b: str):
    """Similarity of two packed signatures, corrected for chance collisions of two bits."""
    half = N_HASH // 64
    differ = sum((F.bit_count(F.get(F.col(a), i).bitwiseXOR(F.get(F.col(b), i)).bitwiseOR(F.get(F.col(a), i + half).bitwiseXOR(F.get(F.col(b), i + half)))) for i in range(half)), F.lit(0))
    return ((1 - differ / N_HASH) - 0.25) / 0.75


def _confirm(percent: int):
    """Rows sorted by pivot and block, the pivot's own texts first: one set is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pivots = None, []
        for pdf in batches:
            out = []
            for a, blk, b, t in zip(pdf["a"].tolist(), pdf["blk"].tolist(), pdf["b"].tolist(), pdf["text"].tolist(), strict=True):
                if (a, blk) != now:
                    now, pivots = (a, blk), []
                x = shingles(t)
                if a == b:
                    pivots.append(x)
                elif any(100 * (both := np.intersect1d(x, y, assume_unique=True).size) >= percent * (len(x) + len(y) - both) for y in pivots):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return run


def pivot_links(pairs: DataFrame, text: DataFrame, percent: int) -> DataFrame:
    """u, v: those of the ``pairs`` (a: pivot, b) that their full texts confirm.

    The members of a pivot are dealt to blocks of about ``BLOCK``; the pivot's text goes to each
    block once, not to each pair, so that a group of any size is spread over tasks.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).withColumnRenamed("a", "n_a")
    dealt = pairs.join(many, F.col("a") == F.col("n_a")).select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("blk"), "b")
    own = many.select(F.col("n_a").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"), F.col("n_a").alias("b"))
    rows = dealt.unionByName(own).join(text, F.col("b") == F.col("class")).select("a", "blk", "b", "text")
    rows = rows.repartition("a", "blk").sortWithinPartitions("a", "blk", F.col("a") != F.col("b"))
    return rows.mapInPandas(_confirm(percent), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (node, root): equal roots for connected nodes; the root is the least node."""
    edges = materialise(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), "edges")
    nodes = materialise(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("at", F.col("node")), "nodes")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        order = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c))
        both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
        step = both.groupBy("x").agg(F.min(order("y")).alias("m")).select("x", F.when(F.struct(F.col("m.col1"), F.col("m.y")) < order("x"), F.col("m.y")).otherwise(F.col("x")).alias("to"))
        step = materialise(step, "step")
        a, b = step.select(F.col("x").alias("ax"), F.col("to").alias("at_u")), step.select(F.col("x").alias("bx"), F.col("to").alias("at_v"))
        before = edges, nodes
        edges = edges.join(a, F.col("u") == F.col("ax")).join(b, F.col("v") == F.col("bx")).select(F.least("at_u", "at_v").alias("u"), F.greatest("at_u", "at_v").alias("v")).filter("u < v").distinct()
        edges = materialise(edges, "edges")
        nodes = materialise(nodes.join(step, F.col("at") == F.col("x"), "left").select("node", F.coalesce("to", "at").alias("at")), "nodes")
        release(*before, step)
    roots = nodes.groupBy("at").agg(F.min("node").alias("root"))
    return nodes.join(roots, "at").select("node", "root")


def _block(percent: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between components among the members of one block of one band.

        Rows on the left side meet rows on the right side; a link is returned only if it joins
        components that no earlier link of the block has joined.
        """
        left, right = pdf[pdf["left"]], pdf if len(key) == 1 else pdf[~pdf["left"]]
        sets = [shingles(t) for t in right["text"]]
        ids, comp = right["class"].to_numpy(), right["comp"].to_numpy()
        size = np.array([len(x) for x in sets])
        order = np.argsort(allof := np.concatenate(sets or [np.empty(0, np.uint64)]), kind="stable")
        allof, owner = allof[order], np.repeat(np.arange(len(sets)), size)[order]
        joined: dict[int, int] = {}

        def top(c: int) -> int:
            while (n := joined.get(c, c)) != c:
                c = n
            return c

        out = []
        for i, c, t in zip(left["class"], left["comp"], left["text"], strict=True):
            x = shingles(t)
            lo, hi = np.searchsorted(allof, x, "left"), np.searchsorted(allof, x, "right")
            many = hi - lo
            at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            for j in np.flatnonzero((100 * both >= percent * (size + len(x) - both)) & (comp != c)):
                if (p := top(c)) != (q := top(comp[j])):
                    joined[max(p, q)] = min(p, q)
                    out.append((i, ids[j]))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return run


def link_classes(sigs: DataFrame, texts: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """(node, root) of the classes that are linked with another, None if there are none.

    ``sigs``: materialised class, bands, sig; ``texts``: class, text.
    """
    member = sigs.select("class", F.explode("bands").alias("band"))
    crowd = member.groupBy("band").agg(F.min("class").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("band").alias("p_band"), "pivot")
    # members of groups of two and more, with the group's pivot
    member = materialise(member.join(crowd, F.col("band") == F.col("p_band")).select("band", "class", "pivot").distinct(), "bands")
    pairs = member.filter("class != pivot").select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct()
    one, two = (sigs.select(F.col("class").alias(f"c{k}"), F.col("sig").alias(f"s{k}")) for k in "ab")
    pairs = pairs.join(one, F.col("a") == F.col("ca")).join(two, F.col("b") == F.col("cb")).filter(estimate("sa", "sb") >= percent / 100 - MARGIN).select("a", "b").distinct()
    pairs = materialise(pairs, "pairs")
    # texts are read once more, for the classes that share a group
    needed = member.select(F.col("class").alias("need")).distinct()
    text = texts.join(needed, F.col("class") == F.col("need"), "left_semi").withColumn("mark", F.xxhash64("text"))
    text = materialise(text.dropDuplicates(["class", "mark"]).drop("mark"), "texts")
    links = materialise(pivot_links(pairs, text, percent), "links")
    roots = materialise(components(links), "roots")
    # pivots have met all their group; of the others, those outside the group's largest
    # component (the left side) meet every member of another component
    rest = member.filter("class != pivot").select("band", "class").join(roots, F.col("class") == F.col("node"), "left").select("band", "class", F.coalesce("root", "class").alias("comp"))
    rest = materialise(rest, "rest")
    sizes = rest.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    lead = sizes.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    lead = lead.select(F.col("band").alias("l_band"), F.col("most.comp").alias("main"), "n", (F.col("n") - F.col("most.n")).alias("outside"))
    rest = materialise(rest.join(lead, F.col("band") == F.col("l_band")).select("band", "class", "comp", (F.col("comp") != F.col("main")).alias("left"), "n", "outside"), "rest")
    if not rest.isEmpty():
        with_text = lambda df: df.join(text, "class")
        few = with_text(rest.filter(F.col("n") <= BLOCK)).select("band", "class", "comp", "left", "text").groupBy("band").applyInPandas(_block(percent), "u long, v long")
        # larger groups: blocks of left members by blocks of members
        mark = F.pmod(F.xxhash64("class"), F.lit(1 << 30))
        many = rest.filter(F.col("n") > BLOCK).withColumns({"lefts": F.ceil(F.col("outside") / BLOCK).cast("int"), "rights": F.ceil(F.col("n") / BLOCK).cast("int")})
        # a left member goes to all blocks of its row, every member to all blocks of its column
        as_left = many.filter("left").select("band", "class", "comp", F.lit(True).alias("left"), (mark % F.col("lefts")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"))
        as_right = many.select("band", "class", "comp", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), (mark % F.col("rights")).cast("int").alias("j"))
        large = with_text(as_left.unionByName(as_right)).select("band", "i", "j", "class", "comp", "left", "text").groupBy("band", "i", "j").applyInPandas(_block(percent), "u long, v long")
        more = materialise(few.unionByName(large).distinct(), "links")
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    return roots


def near_duplicates(docs: DataFrame, percent: int = LINK_PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, kept for every row of ``docs``; linked are documents
    with a similarity of ``percent`` hundredths and more.  ``mark`` is the xxhash64 of the text."""
    sigs = materialise(signatures(docs, bands, rows), "sigs")
    key = ["k1", "k2", "n_shingles"]
    full = sigs.filter("n_shingles > 0 and doc_id is not null")
    groups = materialise(full.groupBy(*key).agg(F.min("doc_id").alias("class")), "classes")
    named = groups.select(*[F.col(c).alias(f"g_{c}") for c in key], "class")
    on = (F.col("k1") == F.col("g_k1")) & (F.col("k2") == F.col("g_k2")) & (F.col("n_shingles") == F.col("g_n_shingles"))
    placed = sigs.join(named, on, "left").drop("g_k1", "g_k2", "g_n_shingles")
    held = materialise(full.join(named, on).filter("doc_id = class").select("class", "bands", "sig", *key).dropDuplicates(["class", *key]), "held")
    texts = docs.select(F.col("doc_id").cast("long").alias("class"), "text").filter("text is not null")
    roots = link_classes(held.select("class", "bands", "sig"), texts, percent)
    placed = placed.join(roots, F.col("class") == F.col("node"), "left")
    comp = F.coalesce("root", "class", "doc_id")
    return placed.select("doc_id", "mark", "n_shingles", comp.alias("component_id"), (F.col("doc_id") == comp).alias("kept"))


def op2_neardup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("mark")
