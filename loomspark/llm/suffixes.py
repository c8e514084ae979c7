"""Operator 13: removal of byte strings that stand in an earlier document, by suffix sorting.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document with a smaller
doc_id.  Texts are whole UTF-8 byte strings; nothing is judged across documents.

1. ``packed``: documents in packs of about a megabyte, compressed, one row each.  All later steps
   reread packs and exchange short answers about them, so that texts are not shuffled as rows.
2. Equal texts are found by digest; only the first one of each goes on (the others go whole).
3. Candidates.  Of each ``LENGTH``-byte window the ``GRAM``-byte strings at its least positions (in
   the order of a hash) are fingerprints; equal windows have equal ones.  Fingerprints, once a
   pack, are dealt by value; those of two texts or more come back as bits.
4. Candidate windows are cut into fragments, dealt by the least hash of a window, so that equal
   windows meet.  Equal fragments of a pack go once, for their smallest document: the others are
   decided there.
5. Blocks of fragments are sorted in two stages (``two_stage``): directly only suffixes that are
   smaller than their successors; the rest is induced by scanning the buckets of first bytes.
   Common prefixes of neighbours (``common_prefixes``) then show which windows are equal; all
   but those of the smallest doc_id are marked.
6. Marked windows come back to their packs, where their bytes are cut out.

Scale: tasks hold one pack or one bucket of bounded size.  A passage in a third of all documents
is one fragment a pack, and equal fragments of a bucket are one before they are sorted.  Windows
that share a least hash beyond a block's size are dealt again by a hash of the whole window.
Fingerprints and fragments are found from all windows; nothing is sampled.

Defined results: null texts are empty; a text of fewer bytes than ``LENGTH`` loses nothing; rows
without doc_id lose nothing and no other row loses by them; rows of one doc_id are one document's:
they lose nothing by each other; repeated rows give repeated results; of equal strings the
smallest doc_id's stay, so there are no ties; a very long text is a pack by itself, worked on in
pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, table

LENGTH = 50
#: Bytes of a fingerprint, and of the strings whose hash orders positions.
GRAM, SEED = 32, 16
EMPTY = hashlib.sha256(b"").hexdigest()


class Sizes(NamedTuple):
    """Bounds of what is held at once; results do not depend on them."""

    pack: int = 1 << 20  # bytes of a pack
    piece: int = 1 << 18  # windows of a piece of a long text
    run: int = 256  # windows of a fragment
    block: int = 1 << 20  # bytes that are sorted at once
    per_prints: int = 24 << 20  # bytes of text for each bucket of fingerprints
    per_fragments: int = 8 << 20  # and for each bucket of fragments


_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


@contextmanager
def _shuffles_go(spark):
    """Shuffle files of a query go when it has ended: each one here ends in a written table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


# --- suffix sorting -------------------------------------------------------------------------


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; true for the least byte, 0, which ends strings."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    # a position's answer is that of the last position of its run of equal bytes
    at = np.searchsorted(change, np.arange(n - 1), "left")
    out = np.ones(n, bool)
    known = at < len(change)
    ends = change[at[known]]
    out[:-1][known] = text[ends] < text[ends + 1]
    out[text == 0] = True
    return out


def two_stage(text: np.ndarray, starts: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """``starts`` in the order of the suffixes there, told apart by ``depth`` bytes at least.

    ``text``: strings of bytes above 0, each ended by 0, a 0 before the first and ``depth`` zeros
    after the last.  Suffixes smaller than their successors are sorted directly, the others are
    placed when a scan of the buckets, from the least byte, meets their successors.
    """
    small = smaller_than_next(text)
    sought = np.zeros(len(text), bool)
    sought[starts] = True
    # successors up to the first suffix that is sorted directly
    edge = starts[~small[starts]] + 1
    while len(edge := edge[~sought[edge]]):
        sought[edge] = True
        edge = edge[~small[edge]] + 1
    direct = np.flatnonzero(sought & small)
    direct = direct[np.argsort(np.ndarray((len(text) - depth + 1,), f"S{depth}", text, 0, (1,))[direct])]
    cuts = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    large = sought & ~small
    for c in range(256):
        parts, last = induced[c], None
        if parts:
            last = np.concatenate(parts)
            parts = [last]
            while len(last := last[large[last - 1] & (text[last - 1] == c)] - 1):  # runs of one byte
                parts.append(last)
        bucket = np.concatenate([*parts, direct[cuts[c] : cuts[c + 1]]])
        out.append(bucket)
        before = bucket - 1
        before = before[large[before] & (text[before] > c)]
        if len(before):
            by = text[before]
            order = np.argsort(by, kind="stable")
            before, by = before[order], by[order]
            for group in np.split(before, np.flatnonzero(by[1:] != by[:-1]) + 1):
                induced[text[group[0]]].append(group)
    order = np.concatenate(out)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Length, ``depth`` at most, of the common prefix of each suffix of ``order`` and the one before it; 0 for the first."""
    word = np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, depth, 8):
        differ = word[order[live] + at].astype(np.uint64) ^ word[order[live - 1] + at].astype(np.uint64)
        same = differ == 0
        out[live[same]] = at + 8
        # leading equal bytes of the word that differs
        odd = differ[~same]
        out[live[~same]] = at + sum((odd >> np.uint64(8 * k) == 0).astype(np.int64) for k in range(1, 8))
        live = live[same]
    return np.minimum(out, depth)


# --- packs ----------------------------------------------------------------------------------

_PACK = pa.schema([("pack", pa.int64()), ("ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])


def _pack(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        squeeze = zstandard.ZstdCompressor(3)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"pack": uuid.uuid4().int >> 65, "ids": ids, "digests": [hashlib.sha256(t).digest() for t in texts], "sizes": [len(t) for t in texts], "data": squeeze.compress(b"".join(texts))}], _PACK)

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= most or len(ids) >= 10_000:
                    yield row()
                    ids, texts, held = [], [], 0
        if ids:
            yield row()

    return run


def packed(docs: DataFrame, most: int = Sizes().pack) -> DataFrame:
    """pack, ids, digests, sizes, data: documents in compressed packs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_pack(most), "pack long, ids array<long>, digests array<binary>, sizes array<long>, data binary")


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x, done = pick(x[:-done], x[done:]), 2 * done
    return pick(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def _ranks(text: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the ``SEED`` bytes at each position."""
    word = np.ndarray((len(text) - 7,), np.uint64, text, 0, (1,))
    x = word[:-8] * _C1
    x += word[8:] * _C2
    x ^= x >> np.uint64(32)
    x *= _C3
    return (x >> np.uint64(32)).astype(np.uint32)


def _least(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least rank of each window's ``GRAM``-byte strings, positions that are least in some window)."""
    width = LENGTH - GRAM + 1
    ranks = ranks[: len(ranks) - (GRAM - SEED)]
    least = _slide(ranks, width, np.minimum)
    pad = np.zeros(width - 1, np.uint32)
    top = _slide(np.concatenate([pad, least, pad]), width, np.maximum)
    return least, np.flatnonzero(ranks == top)


def _prints(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ``GRAM``-byte strings at the positions."""
    word = np.ndarray((len(text) - 7,), np.uint64, text, 0, (1,))
    x = word[at] * _C1
    for i in range(8, GRAM, 8):
        x = ((x ^ (x >> np.uint64(29))) + word[at + i]) * _C2
    x ^= x >> np.uint64(32)
    x *= _C3
    return x ^ (x >> np.uint64(29))


def _pieces(data: bytes, sizes: list[int], piece: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number of the document, offset in it, bytes): every window stands in one piece."""
    text, at = np.frombuffer(data, np.uint8), 0
    for i, size in enumerate(sizes):
        for start in range(0, size - LENGTH + 1, piece):
            yield i, start, text[at + start : at + min(size, start + piece + LENGTH - 1)]
        at += size


def _all_prints(data: bytes, sizes: list[int], piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, document) of a pack, in the order of the pieces."""
    prints, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for i, _, text in _pieces(data, sizes, piece):
        _, at = _least(_ranks(text))
        prints.append(_prints(text, at))
        owner.append(np.full(len(at), i))
    return np.concatenate(prints), np.concatenate(owner)


# --- candidates -----------------------------------------------------------------------------

_ASK = pa.schema([("bucket", pa.int64()), ("pack", pa.int64()), ("owners", pa.binary()), ("counts", pa.binary()), ("prints", pa.binary())])


def _asks(buckets: int, piece: int):
    """Rows for each bucket: low five bytes of its fingerprints, by owner (the digest of the only
    text of the pack that has it, 0 for several)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, digests, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("pack", "digests", "sizes", "data")), strict=True):
                name = np.array([int.from_bytes(d[:8], "little") | 1 for d in digests], np.uint64)
                prints, doc = _all_prints(zstandard.decompress(data), sizes, piece)
                if not len(prints):
                    continue
                owner = name[doc]
                order = np.argsort(prints, kind="stable")
                prints, owner = prints[order], owner[order]
                first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
                owner = np.where(np.minimum.reduceat(owner, first) == np.maximum.reduceat(owner, first), owner[first], np.uint64(0))
                prints = prints[first]
                bucket = (prints >> np.uint64(40)) % np.uint64(buckets)
                order = np.lexsort((owner, bucket))
                prints, owner, bucket = prints[order], owner[order], bucket[order].astype(np.int64)
                rows = []
                for a, b in _runs(bucket):
                    own = [(owner[a + x], y - x) for x, y in _runs(owner[a:b])]
                    low = prints[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                    rows.append({"bucket": int(bucket[a]), "pack": pack, "owners": np.array([x for x, _ in own], np.uint64).tobytes(), "counts": np.array([n for _, n in own], np.uint32).tobytes(), "prints": low.tobytes()})
                yield pa.RecordBatch.from_pylist(rows, _ASK)

    return run


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    if not len(x):
        return []
    cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _low(prints: np.ndarray) -> np.ndarray:
    return prints & np.uint64((1 << 40) - 1)


def _five(values: list[bytes]) -> np.ndarray:
    """Numbers of five bytes each."""
    low = np.frombuffer(b"".join(values), np.uint8).reshape(-1, 5)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :5] = low
    return out.view("<u8").ravel()


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each pack those of its fingerprints of one bucket that two texts or more have."""
    asked = _five(pdf["prints"].tolist())
    row = np.repeat(np.arange(len(pdf)), [len(x) // 5 for x in pdf["prints"]])
    owner = np.concatenate([np.repeat(np.frombuffer(o, np.uint64), np.frombuffer(n, np.uint32)) for o, n in zip(pdf["owners"], pdf["counts"], strict=True)])
    order = np.argsort(asked, kind="stable")
    asked, owner, row = asked[order], owner[order], row[order]
    first = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]])
    least = np.minimum.reduceat(owner, first)
    shared = np.repeat((least != np.maximum.reduceat(owner, first)) | (least == 0), np.diff([*first, len(asked)]))
    asked, row = asked[shared], row[shared]
    order = np.argsort(row, kind="stable")
    asked, row = asked[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5], row[order]
    cuts = _runs(row)
    return pd.DataFrame({"pack": pdf["pack"].to_numpy()[[row[a] for a, _ in cuts]], "found": [asked[a:b].tobytes() for a, b in cuts]})


# --- fragments ------------------------------------------------------------------------------

#: A place in a pack: number of the document, then the byte in it.
_SHIFT = 40
_FRAGMENT = pa.schema([("bucket", pa.int64()), ("pack", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("lens", pa.binary()), ("places", pa.binary()), ("counts", pa.binary()), ("texts", pa.binary())])
_FRAGMENT_DDL = "bucket long, pack long, keys binary, docs binary, lens binary, places binary, counts binary, texts binary"


class _Fragments:
    """Distinct fragments with their smallest document and its places; what larger ones lose is marked."""

    def __init__(self) -> None:
        self.held: dict[bytes, list] = {}
        self.marks: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, text: bytes, key: int, doc: int, pack: int, places: list[int]) -> None:
        if (now := self.held.get(text)) is None:
            self.held[text] = [doc, key, [(pack, places)]]
        elif doc == now[0]:
            now[2].append((pack, places))
        else:
            lost = [(pack, places)]
            if doc < now[0]:
                lost, now[0], now[2] = now[2], doc, lost
            for p, at in lost:
                self.marks[p] += [(x, len(text) - LENGTH + 1) for x in at]


def _cut_up(buckets: int, piece: int, longest: int):
    """Fragments of the candidate windows of packs, by bucket; bucket -1: windows marked already."""

    def rows(pack: int, ids: list, sizes: list, data: bytes, found: np.ndarray, firsts: set) -> list[dict]:
        out = _Fragments()
        for i, start, text in _pieces(data, sizes, piece):
            if i not in firsts:
                continue
            ranks = _ranks(text)
            least, at = _least(ranks)
            asked = _low(_prints(text, at))
            shared = at[found[np.searchsorted(found, asked)] == asked]
            if not len(shared):
                continue
            known = np.full(len(text) - GRAM + 1, np.uint32(0xFFFFFFFF))
            known[shared] = ranks[shared]
            windows = np.flatnonzero(_slide(known, LENGTH - GRAM + 1, np.minimum) == least)
            key = _slide(ranks, LENGTH - SEED + 1, np.minimum)[windows]
            new = np.r_[True, (windows[1:] != windows[:-1] + 1) | (key[1:] != key[:-1])]
            inside = np.arange(len(windows)) - np.maximum.accumulate(np.where(new, np.arange(len(windows)), 0))
            cuts = np.flatnonzero(inside % longest == 0)
            whole, base = text.tobytes(), (i << _SHIFT) + start
            for a, n, k in zip(windows[cuts].tolist(), np.diff([*cuts, len(windows)]).tolist(), key[cuts].tolist(), strict=True):
                out.add(whole[a : a + n + LENGTH - 1], k, ids[i], pack, [base + a])
        return _emitted(out, pack, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, ids, sizes, data, found, firsts in zip(*(batch.column(c).to_pylist() for c in ("pack", "ids", "sizes", "data", "found", "firsts")), strict=True):
                got = rows(pack, ids, sizes, zstandard.decompress(data), np.sort(np.append(_five(found), ~np.uint64(0))), set(firsts))
                if got:
                    yield pa.RecordBatch.from_pylist(got, _FRAGMENT)

    return run


def _emitted(out: _Fragments, pack: int, buckets: int) -> list[dict]:
    by: dict[int, list] = defaultdict(list)
    for text, (doc, key, at) in out.held.items():
        by[(key * 0x9E3779B97F4A7C15 >> 32) % buckets].append((key, doc, text, [x for _, places in at for x in places]))
    rows, squeeze = [], zstandard.ZstdCompressor(3)
    for bucket, these in by.items():
        these.sort()
        keys, docs, texts, places = zip(*these, strict=True)
        rows.append({"bucket": bucket, "pack": pack, "keys": np.array(keys, np.uint32).tobytes(), "docs": np.array(docs, np.int64).tobytes(), "lens": np.array([len(t) for t in texts], np.uint32).tobytes(), "places": np.array([x for p in places for x in p], np.int64).tobytes(), "counts": np.array([len(p) for p in places], np.uint32).tobytes(), "texts": squeeze.compress(b"".join(texts))})
    for p, marks in out.marks.items():
        places, lens = zip(*marks, strict=True)
        rows.append({"bucket": -1, "pack": p, "places": np.array(places, np.int64).tobytes(), "lens": np.array(lens, np.int64).tobytes()})
    return rows


def _marked(texts: list[bytes], docs: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(windows of each fragment, whether each also starts in a fragment of a smaller document)."""
    # 0xFF stands in no UTF-8 text: bytes move up by one, and it becomes 0
    text = np.frombuffer(b"\xff" + b"\xff".join(texts) + b"\xff" * (LENGTH + 16), np.uint8) + np.uint8(1)
    many = np.array([len(t) - LENGTH + 1 for t in texts])
    at = 1 + np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    doc = np.zeros(len(text), np.int64)
    starts = np.repeat(at - np.cumsum([0, *many[:-1]]), many) + np.arange(many.sum())
    doc[starts] = np.repeat(docs, many)
    order = two_stage(text, starts)
    own = doc[order]
    first = np.flatnonzero(common_prefixes(text, order) < LENGTH)
    lost = np.zeros(len(text), bool)
    lost[order] = own > np.repeat(np.minimum.reduceat(own, first), np.diff([*first, len(order)]))
    return many, lost[starts]


def _blocks(fragments: list[tuple[int, int, bytes]], most: int) -> Iterator[tuple[list[bytes], list[int], list[tuple[int, int]]]]:
    """(texts, documents, (fragment, first window)) of blocks; fragments (key, document, text) sorted by key.

    Keys stay whole; one beyond a block is dealt by the hash of each window.
    """
    size, block = 0, []
    for a, b in _runs(np.array([k for k, *_ in fragments], np.int64)):
        held = sum(len(t) for *_, t in fragments[a:b])
        if size + held > most and block:
            yield [fragments[i][2] for i in block], [fragments[i][1] for i in block], [(i, 0) for i in block]
            size, block = 0, []
        if held <= most:
            size += held
            block += range(a, b)
            continue
        parts = sum(len(t) - LENGTH + 1 for *_, t in fragments[a:b]) * LENGTH // most + 1
        for part in range(parts):
            texts, docs, refs = [], [], []
            for i in range(a, b):
                _, doc, t = fragments[i]
                for w in range(len(t) - LENGTH + 1):
                    if hash(x := t[w : w + LENGTH]) % parts == part:
                        texts.append(x)
                        docs.append(doc)
                        refs.append((i, w))
            if texts:
                yield texts, docs, refs
    if block:
        yield [fragments[i][2] for i in block], [fragments[i][1] for i in block], [(i, 0) for i in block]


def _resolve(most: int):
    """Marked windows (places, lens) by pack, of the fragments of one bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _Fragments()
        for row in pdf.itertuples(index=False):
            keys, docs, lens, counts = (np.frombuffer(x, t).tolist() for x, t in ((row.keys, np.uint32), (row.docs, np.int64), (row.lens, np.uint32), (row.counts, np.uint32)))
            places, texts, p, t = np.frombuffer(row.places, np.int64).tolist(), zstandard.decompress(row.texts), 0, 0
            for key, doc, size, n in zip(keys, docs, lens, counts, strict=True):
                out.add(texts[t : t + size], key, doc, row.pack, places[p : p + n])
                t, p = t + size, p + n
        fragments = sorted((key, doc, text) for text, (doc, key, _) in out.held.items())
        for texts, docs, refs in _blocks(fragments, most):
            many, lost = _marked(texts, docs)
            ends = np.cumsum(many)
            gone = np.add.reduceat(lost.astype(np.int64), ends - many)
            for f in np.flatnonzero(gone).tolist():
                (i, w), n, end = refs[f], int(many[f]), int(ends[f])
                runs = [(0, n)] if gone[f] == n else [(x, y) for x, y in _runs(lost[end - n : end]) if lost[end - n + x]]
                for pack, places in out.held[fragments[i][2]][2]:
                    out.marks[pack] += [(x + w + a, b - a) for x in places for a, b in runs]
        packs = list(out.marks)
        columns = [list(zip(*out.marks[p], strict=True)) for p in packs]
        return pd.DataFrame({"pack": packs, "places": [np.array(x, np.int64).tobytes() for x, _ in columns], "lens": [np.array(x, np.int64).tobytes() for _, x in columns]}).astype({"pack": "int64"})

    return run


# --- results --------------------------------------------------------------------------------

_CUT = pa.schema([("digest", pa.binary()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept_sha256", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for digests, sizes, data, places, lens in zip(*(batch.column(c).to_pylist() for c in ("digests", "sizes", "data", "places", "lens")), strict=True):
            place, n = (np.frombuffer(b"".join(x), np.int64) for x in (places, lens))
            order = np.argsort(place, kind="stable")
            place, end = place[order], (place + n + LENGTH - 1)[order]
            far = np.maximum.accumulate(end)
            new = np.flatnonzero(np.r_[True, place[1:] > far[:-1]])  # a place holds the document: spans of two never touch
            a, b = place[new], far[[*(new[1:] - 1), len(far) - 1]]
            text, at = zstandard.decompress(data), np.cumsum([0, *sizes])
            rows = []
            for x, y in _runs(doc := a >> _SHIFT):
                i = int(doc[x])
                spans = np.stack([a[x:y], b[x:y]], 1) - (i << _SHIFT)
                kept, done = hashlib.sha256(), 0
                for s, e in spans.tolist():
                    kept.update(text[at[i] + done : at[i] + s])
                    done = e
                kept.update(text[at[i] + done : at[i + 1]])
                rows.append({"digest": digests[i], "n_removed": int((spans[:, 1] - spans[:, 0]).sum()), "spans": spans.tolist(), "kept_sha256": kept.hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, _CUT)


def repeated_strings(docs: DataFrame, at_once: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans ([start, end) of what goes, in bytes), kept_sha256 for every row of ``docs``."""
    spark = docs.sparkSession
    with _shuffles_go(spark):
        packs = materialise(packed(docs, at_once.pack), "packs")
        rows = packs.select("pack", F.posexplode(F.arrays_zip("ids", "digests", "sizes")).alias("pos", "doc")).select("pack", "pos", F.col("doc.ids").alias("doc_id"), F.col("doc.digests").alias("digest"), F.col("doc.sizes").alias("n_bytes"))
        total = packs.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
        first = rows.filter((F.col("n_bytes") >= LENGTH) & F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("doc_id", "pack", "pos")).alias("first"))
        first = materialise(first.select("digest", "first.*"), "firsts")
        asks = packs.select("pack", "digests", "sizes", "data").mapInArrow(_asks(int(total // at_once.per_prints) + 1, at_once.piece), "bucket long, pack long, owners binary, counts binary, prints binary")
        found = materialise(asks.groupBy("bucket").applyInPandas(_answers, "pack long, found binary"), "found")
        found_of = found.groupBy("pack").agg(F.collect_list("found").alias("found"))
        firsts_of = first.groupBy("pack").agg(F.collect_list("pos").alias("firsts"))
        fragments = packs.drop("digests").join(found_of, "pack").join(firsts_of, "pack").select("pack", "ids", "sizes", "data", "found", "firsts").mapInArrow(_cut_up(int(total // at_once.per_fragments) + 1, at_once.piece, at_once.run), _FRAGMENT_DDL)
        fragments = materialise(fragments, "fragments")
        release(found)
        marks = fragments.filter("bucket >= 0").groupBy("bucket").applyInPandas(_resolve(at_once.block), "pack long, places binary, lens binary")
        marks = materialise(marks.unionByName(fragments.filter("bucket < 0").select("pack", "places", "lens")), "marks")
        release(fragments)
        marks_of = marks.groupBy("pack").agg(F.collect_list("places").alias("places"), F.collect_list("lens").alias("lens"))
        cuts = packs.select("pack", "digests", "sizes", "data").join(marks_of, "pack").mapInArrow(_cut, "digest binary, n_removed long, spans array<array<long>>, kept_sha256 string")
        cuts = materialise(cuts, "cuts")
        release(marks)
    out = rows.join(first.select("digest", F.col("doc_id").alias("first_id")), "digest", "left").join(cuts, "digest", "left")
    none, whole = F.array().cast("array<array<long>>"), F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))
    copy = F.col("doc_id") > F.col("first_id")  # null without doc_id, and for short texts
    pick = lambda gone, part, rest: F.when(F.col("doc_id").isNull(), rest).when(copy, gone).otherwise(F.coalesce(part, rest))
    return out.select("doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"), pick(whole, F.col("spans"), none).alias("spans"), pick(F.lit(EMPTY), F.col("kept_sha256"), F.lower(F.hex("digest"))).alias("kept_sha256"))


def op13_repeats(spark, sf_dir):
    out = repeated_strings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
