"""Operator 12: the prefix trie of rebuilt conversations.

1. Each conversation is rebuilt from the first turns of its group's first conversation and its
   own later turns.  A turn travels as a digest of role and text and a length, never as text.
2. One sorted stream chains the digests: the name of the node of depth d is a hash of the name
   at d - 1 and the d-th turn.  Equal names are one node, counted by a partial aggregate.
3. Nodes of one member (most of them) are chains whose figures follow from their own row.
   Subtrees of at most ``HEAVY`` members hang below heavy nodes; they are dealt by their top
   node to shards.  A shard is a forest in level order: a LOUDS bit vector (one bit 1 for each
   child, then a 0, for each node) with label arrays beside it; children and parents are read
   from the bits, and figures are summed from the last level to the first by ``numpy.add.at``.
4. Upper levels, whose subtrees are spread over shards, are merged apart: each conversation
   gathers what it counts for (a node counts at its smallest member) from its end to its start,
   and a partial aggregate adds these up by heavy node.  The root is a sum over all.

Scale: shuffles carry about 100 bytes a turn.  A name that a third of all conversations share
meets its count in a join that AQE may split; a conversation of any length is a stream; the
digest of the ends of one node is a sorted stream as well.  A shard holds distinct nodes only.

Defined results: null role and text are empty; rows without conv_id belong to no conversation
and go; null turns come first; rows of equal turn (repeated ones too, which all count) stand by
the digest of role and text; very long texts only are digested; without conversations there are
no rows, not even the root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, table

#: Conversations of one group share the first turns of its first; HEADS is the modulus of how many.
GROUP, HEADS = 100, 6
#: Members above which a node belongs to the upper levels; nodes a shard aims at.
HEAVY, SHARD = 4096, 100_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, head), (turns: conv_id, part, n, turn digest, chars in order of part and n)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    turns = turns.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")))
    head = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    turns = materialise(turns.select("conv_id", "n", "digest", "chars"), "turns")
    convs = turns.filter("n = 1").select("conv_id", head.alias("head"))
    first = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("n") < HEADS)).select(F.col("conv_id").alias("of"), "n", "digest", "chars")
    lent = convs.join(first, (F.col("conv_id") - F.col("conv_id") % GROUP == F.col("of")) & (F.col("n") <= F.col("head")))
    own = turns.filter(F.col("n") > head)
    parts = lent.select("conv_id", F.lit(0).alias("part"), "n", "digest", "chars").unionByName(own.select("conv_id", F.lit(1).alias("part"), "n", "digest", "chars"))
    return convs, parts


_PATH = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64()), ("ends", pa.bool_())])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, depth, node, out = None, 0, b"", []
    for batch in batches:
        for conv, digest, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "chars")), strict=True):
            if conv != now:
                if out:
                    out[-1]["ends"] = True
                now, depth, node = conv, 0, b""
            above, node, depth = node, hashlib.blake2b(node + digest, digest_size=16).digest(), depth + 1
            out.append({"conv_id": conv, "depth": depth, "node": node, "parent": above, "chars": chars, "ends": False})
        if len(out) > 10_000:  # the last row waits: the next batch may go on below it
            yield pa.RecordBatch.from_pylist(out[:-1], _PATH)
            out = out[-1:]
    if out:
        out[-1]["ends"] = True
    yield pa.RecordBatch.from_pylist(out, _PATH)


def paths(parts: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, chars, ends: the nodes that each conversation passes, root left out."""
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "n").select("conv_id", "digest", "chars")
    return rows.mapInArrow(_chain, "conv_id long, depth long, node binary, parent binary, chars long, ends boolean")


def louds(degrees: np.ndarray) -> np.ndarray:
    """The level-order bit vector of a forest whose nodes, the super-root first, have so many children."""
    bits = np.zeros(int(degrees.sum()) + len(degrees), np.uint8)
    ends = np.cumsum(degrees + 1) - 1
    bits[:] = 1
    bits[ends] = 0
    return bits


def louds_parents(bits: np.ndarray) -> np.ndarray:
    """For each node but the super-root, its parent: the zeros before its bit."""
    return np.cumsum(bits == 0)[bits == 1]


def louds_degrees(bits: np.ndarray) -> np.ndarray:
    """Children of each node, the super-root first: the ones between two zeros."""
    return np.diff(np.flatnonzero(bits == 0), prepend=-1) - 1


def _level_order(node: list[bytes], parent: list[bytes], depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(level order, children of super-root and nodes in it, where levels start); tops have a parent outside."""
    at = {x: i for i, x in enumerate(node)}
    up = np.fromiter((at.get(x, -1) for x in parent), np.int64, len(parent))
    place, order, starts, done = np.zeros(len(node) + 1, np.int64), [], [], 1
    # tops stand at several depths: a level is counted from its top
    level = np.zeros(len(node), np.int64)
    for i in np.argsort(depth, kind="stable").tolist():
        level[i] = level[up[i]] + 1 if up[i] >= 0 else 0
    by_level = np.argsort(level, kind="stable")
    for these in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1):
        these = these[np.argsort(place[up[these]], kind="stable")]
        place[these] = np.arange(done, done + len(these))
        starts.append(done)
        order.append(these)
        done += len(these)
    place[-1] = 0  # index -1: the super-root
    return np.concatenate(order), np.bincount(place[up], minlength=len(node) + 1), starts


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Children, leaves and savings of the nodes of one shard."""
    order, degrees, starts = _level_order(pdf["node"].tolist(), pdf["parent"].tolist(), pdf["depth"].to_numpy())
    bits = louds(degrees)
    up, degrees = louds_parents(bits), louds_degrees(bits)
    pdf = pdf.iloc[order]
    # label arrays, the super-root at 0
    saved = np.concatenate([[0], (pdf["n_convs"].to_numpy() - 1) * pdf["chars"].to_numpy()])
    leaves = (degrees == 0).astype(np.int64)
    ends = [*starts[1:], len(up) + 1]
    for a, b in zip(reversed(starts), reversed(ends), strict=True):
        np.add.at(saved, up[a - 1 : b - 1], saved[a:b])
        np.add.at(leaves, up[a - 1 : b - 1], leaves[a:b])
    return pdf[["node", "conv_id", "depth", "parent_conv_id", "n_convs", "is_top"]].assign(n_children=degrees[1:], n_leaves=leaves[1:], saved_tokens=saved[1:])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the sorted members that end at each node."""
    schema = pa.schema([("at", pa.binary()), ("ends_sha256", pa.string())])
    now, sha, out = None, None, []
    for batch in batches:
        for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if node != now:
                if sha is not None:
                    out.append({"at": now, "ends_sha256": sha.hexdigest()})
                now, sha = node, hashlib.sha256(str(conv).encode())
            else:
                sha.update(f",{conv}".encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if sha is not None:
        out.append({"at": now, "ends_sha256": sha.hexdigest()})
    yield pa.RecordBatch.from_pylist(out, schema)


def placed(path: DataFrame, heavy: int) -> DataFrame:
    """The rows of ``path`` that later steps need (a node's at its smallest member, a heavy node's at
    all, a shared node's at members that end there), with the node's figures and the path's
    turning points: where it leaves the heavy nodes, and where it is alone."""
    nodes = path.groupBy(F.col("node").alias("at")).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("least"), F.sum(F.col("ends").cast("long")).alias("n_ends"))
    rows = path.join(nodes, F.col("node") == F.col("at")).drop("at")
    conv = Window.partitionBy("conv_id")
    rows = rows.withColumns({
        "parent_conv_id": F.lag("least").over(conv.orderBy("depth")),
        "n_parent": F.lag("n_convs").over(conv.orderBy("depth")),
        "top": F.min(F.when(F.col("n_convs") <= heavy, F.struct("depth", "node"))).over(conv),
        "alone": F.min(F.when(F.col("n_convs") == 1, F.col("depth"))).over(conv),
    })
    return rows.filter((F.col("conv_id") == F.col("least")) | (F.col("n_convs") > heavy) | (F.col("ends") & (F.col("n_convs") > 1)))


def trie(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations of ``rows``."""
    convs, parts = rebuilt(rows)
    path = materialise(paths(parts), "paths")
    at = materialise(placed(path, heavy), "placed")
    mine = at.filter("conv_id = least")
    root_id, n_all = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    single = mine.filter("n_convs = 1").select("conv_id", "depth", "parent_conv_id", "n_convs", F.when(F.col("ends"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"))

    # shards: distinct light nodes, chains cut below their first node
    inner = mine.filter((F.col("n_convs") <= heavy) & ((F.col("n_convs") > 1) | (F.col("depth") == F.col("alone"))))
    inner = inner.filter(~((F.col("n_convs") == 1) & (F.col("depth") == F.col("top.depth"))))
    shards = max(1, inner.count() // SHARD)
    inner = inner.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "chars", (F.col("depth") == F.col("top.depth")).alias("is_top"), F.pmod(F.xxhash64("top.node"), F.lit(shards)).alias("shard"))
    done = inner.groupBy("shard").applyInPandas(_shard, "node binary, conv_id long, depth long, parent_conv_id long, n_convs long, is_top boolean, n_children long, n_leaves long, saved_tokens long")
    done = materialise(done, "shards")
    light = done.filter("n_convs > 1").select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")

    # upper levels: what each conversation counts for, gathered from its end to its start
    is_least, own = F.col("conv_id") == F.col("least"), F.col("n_convs") > heavy
    upper = at.filter(own).select("conv_id", "depth", "node", F.when(is_least & (F.col("n_ends") == F.col("n_convs")), 1).otherwise(0).cast("long").alias("leaves"), F.when(is_least, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0).alias("saved"))
    below = done.filter("is_top and depth > 1").select("conv_id", "depth", F.lit(None).cast("binary").alias("node"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    tops = mine.filter((F.col("n_convs") == 1) & (F.col("n_parent") > heavy)).select("conv_id", "depth", F.lit(None).cast("binary").alias("node"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    onward = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = upper.unionByName(below).unionByName(tops).withColumns({"leaves": F.sum("leaves").over(onward), "saved": F.sum("saved").over(onward)})
    sums = sums.filter("node is not null").groupBy(F.col("node").alias("s_node")).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    children = mine.filter(F.col("n_parent") > heavy).groupBy(F.col("parent").alias("c_node")).agg(F.count(F.lit(1)).alias("children"))
    high = mine.filter(own).join(sums, F.col("node") == F.col("s_node")).join(children, F.col("node") == F.col("c_node"), "left")
    high = high.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens")

    ends = at.filter("ends and n_convs > 1").select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_ends, "at binary, ends_sha256 string")
    shared = light.unionByName(high).join(ends, F.col("node") == F.col("at"), "left").select(*COLUMNS[:-1], F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))

    # the root: sums over all nodes, and members without turns
    turnless = convs.join(path.filter("depth = 1").select(F.col("conv_id").alias("has")), F.col("conv_id") == F.col("has"), "left_anti")
    turnless = turnless.select(F.lit(b"").alias("node"), "conv_id").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_ends, "at binary, ends_sha256 string").first()
    null, number = F.lit(None).cast("long"), lambda n: F.lit(n).cast("long")
    root = mine.agg(F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"), F.count(F.when(F.col("n_ends") == F.col("n_convs"), 1)).alias("n_leaves"), F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("chars")), F.lit(0)).alias("saved_tokens")).filter(F.lit(n_all > 0))
    root = root.select(number(root_id).alias("conv_id"), number(0).alias("depth"), null.alias("parent_conv_id"), number(n_all).alias("n_convs"), "n_children", F.greatest("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), "saved_tokens", F.lit(turnless.ends_sha256 if turnless else NO_ENDS).alias("ends_sha256"))
    rest = single.unionByName(shared).withColumn("parent_conv_id", F.when(F.col("depth") == 1, number(root_id)).otherwise(F.col("parent_conv_id")))
    return rest.unionByName(root).select(*COLUMNS)


def op12_prefixtrie(spark, sf_dir):
    return trie(table(spark, sf_dir, "conversations"))
