"""Operator 3: edit-aware token counts.

A document's text is split into pre-tokens; the leaves of its segment tree hold each
pre-token's length and number of tokens, inner nodes the sums of ``FAN`` children.  The root
is the document's token count.  An edit replaces a character range.  Only the pre-tokens it
touches, one before them as boundary context, and what follows until the new split falls on an
old border again, are split and encoded anew; their leaves are replaced and the sums above
them updated.  Everything else keeps its counts.

Why that is exact: the pre-token pattern looks at most two characters past a match and never
back, so a pre-token that ends two characters before the edit stays, and once a new border
meets an old one behind the edit the rest is the same.

Trees can be kept: ``plant`` gives each document's leaves as arrays to be stored, and
``edit_stored`` takes stored trees and new edits and gives new trees; what no edit touches is
neither split nor encoded a second time.

Scale: a map over documents with their own edits; edits are grouped by document (bounded by
one document's edits) before they meet the text by an equi-join.  Only the documents with
edits shuffle; without edits there is no shuffle.  The vocabulary (under 1 MB) is broadcast.

Defined results: null and empty texts have 0 tokens and can be edited like any text;
edits apply in the order of ``seq``, ranges beyond the text are cut to it; edits of unknown
documents are ignored; repeated rows are edited alike; edits with an equal ``seq`` apply in the
order of their ranges; a very long text is one tree; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
FAN = 32
MOST_REMEMBERED = 400_000


class Counter:
    """Tokens per pre-token, remembered."""

    def __init__(self, content: bytes, pattern: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.coding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        if (n := self.known.get(piece)) is None:
            n = len(self.coding.encode_ordinary(piece))
            if len(self.known) > MOST_REMEMBERED:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n


class Tree:
    """Segment tree over pre-tokens with sums of lengths and of tokens."""

    def __init__(self, counter: Counter, text: str) -> None:
        self.counter, self.text = counter, text
        pieces = counter.pattern.findall(text)
        self.levels = [(list(map(len, pieces)), list(map(counter.count, pieces)))]
        self._sum_from(0)
        self.encoded = 0  # pre-tokens encoded since the tree was built

    @classmethod
    def stored(cls, counter: Counter, text: str, lengths: list[int], counts: list[int]) -> Tree:
        """A tree from its stored leaves: sums only, nothing is split or encoded."""
        if sum(lengths) != len(text):
            raise ValueError("the leaves do not cover the text")
        tree = cls.__new__(cls)
        tree.counter, tree.text, tree.encoded = counter, text, 0
        tree.levels = [(list(lengths), list(counts))]
        tree._sum_from(0)
        return tree

    def _sum_from(self, leaf: int, until: int | None = None) -> None:
        """Sums above the leaves from ``leaf`` on, up to ``until`` if their number is unchanged."""
        k, lo, hi = 0, leaf, until
        while len(self.levels[k][0]) > FAN:
            if k + 1 == len(self.levels):
                self.levels.append(([], []))
            lo //= FAN
            below, above = self.levels[k], self.levels[k + 1]
            size = -(-len(below[0]) // FAN)
            if hi is None or len(above[0]) != size:
                hi = None
                end = size
            else:
                hi = end = min(size, -(-hi // FAN))
            for s, d in zip(below, above, strict=True):
                d[lo : end if hi is not None else None] = [sum(s[i * FAN : (i + 1) * FAN]) for i in range(lo, end)]
            k += 1
        del self.levels[k + 1 :]

    @property
    def tokens(self) -> int:
        return sum(self.levels[-1][1])

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (or the end) and where it starts."""
        node, start = 0, 0
        for k in range(len(self.levels) - 1, -1, -1):
            sizes = self.levels[k][0]
            end = min(len(sizes), node + FAN) if k < len(self.levels) - 1 else len(sizes)
            while node < end and start + sizes[node] <= at:
                start += sizes[node]
                node += 1
            if node == end and k:
                node = end - 1
                start -= sizes[node]
            if k:
                node *= FAN
        return node, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] by ``new``."""
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        lengths, counts = self.levels[0]
        # the last leaf that surely stays ends at start - 2 or before
        first, at = self._find(max(0, start - 2)) if lengths else (0, 0)
        if first and first >= len(lengths):
            first -= 1
            at -= lengths[first]
        text = self.text[:start] + new + self.text[end:]
        shift = len(text) - n
        old, border = first, at  # leaf and border of the old split that may be met again
        pieces, pos = [], at
        while pos < len(text):
            if pos >= start + len(new):
                while old < len(lengths) and (border < end or border + shift < pos):
                    border += lengths[old]
                    old += 1
                if border >= end and border + shift == pos:
                    break
            piece = self.counter.pattern.match(text, pos)[0]
            pieces.append(piece)
            pos += len(piece)
        else:
            old = len(lengths)
        same = len(pieces) == old - first
        lengths[first:old] = map(len, pieces)
        counts[first:old] = map(self.counter.count, pieces)
        self.text, self.encoded = text, self.encoded + len(pieces)
        self._sum_from(first, first + len(pieces) if same else None)


_counters: dict[bytes, Counter] = {}


def _counter(shared) -> Counter:
    """The worker's counter for a vocabulary and pattern, whatever other ones it has met."""
    content, pattern = shared.value
    key = sha256(content + b"\0" + pattern.encode()).digest()
    if (c := _counters.get(key)) is None:
        _counters.clear()
        c = _counters[key] = Counter(content, pattern)
    return c


def _vocabulary(spark, path: str | None, pattern: str | None):
    import public_tokenizers

    with open(path or str(public_tokenizers.path(VOCABULARY)), "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern or public_tokenizers.PATTERN))


def _with_edits(df: DataFrame, edits: DataFrame) -> DataFrame:
    """``df`` with the array ``edits`` of each doc_id, by seq; null without any."""
    each = F.struct(F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce("new", F.lit("")).alias("new"))
    per = edits.groupBy(F.col("doc_id").cast("long").alias("e_doc")).agg(F.array_sort(F.collect_list(each)).alias("edits"))
    return df.join(per, F.col("doc_id") == F.col("e_doc"), "left").drop("e_doc")


TREE = "doc_id long, text string, lengths array<int>, counts array<int>, n_tokens long, n_encoded long"


def plant(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The trees of ``docs``, to be stored: doc_id, text, the leaves (lengths, counts), n_tokens,
    n_encoded (pre-tokens encoded to make them)."""
    shared = _vocabulary(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(shared)
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                tree = Tree(counter, t or "")
                rows.append((None if i != i else i, tree.text, *tree.levels[0], tree.tokens, len(tree.levels[0][0])))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "lengths", "counts", "n_tokens", "n_encoded"], dtype=object)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, TREE)


def edit_stored(trees: DataFrame, edits: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Stored ``trees`` after ``edits`` (doc_id, seq, start, end, new), in the same form.

    Trees without edits go through as they are, outside Python; of the others only what an
    edit touches is split and encoded anew, which ``n_encoded`` counts."""
    shared = _vocabulary(trees.sparkSession, path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(shared)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                tree = Tree.stored(counter, r.text, list(r.lengths), list(r.counts))
                for e in r.edits:
                    tree.edit(int(e["start"]), int(e["end"]), e["new"])
                lengths, counts = tree.levels[0]
                rows.append((None if r.doc_id != r.doc_id else r.doc_id, tree.text, lengths, counts, tree.tokens, tree.encoded))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "lengths", "counts", "n_tokens", "n_encoded"], dtype=object)

    both = _with_edits(trees.select("doc_id", "text", "lengths", "counts", "n_tokens"), edits)
    changed = both.filter("edits is not null").mapInPandas(run, TREE)
    same = both.filter("edits is null").select("doc_id", "text", "lengths", "counts", "n_tokens", F.lit(0).cast("long").alias("n_encoded"))
    return same.unionByName(changed)


def count_with_edits(docs: DataFrame, edits: DataFrame | None = None, path: str | None = None, pattern: str | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_edits, n_encoded (and text) for every row of ``docs``.

    ``edits``: doc_id, seq, start, end, new.  ``n_encoded`` counts the pre-tokens that the
    edits caused to be encoded anew.
    """
    shared = _vocabulary(docs.sparkSession, path, pattern)
    df = docs.select(F.col("doc_id").cast("long"), "text")
    if edits is None:
        df = df.withColumn("edits", F.array().cast("array<struct<seq:long,start:long,end:long,new:string>>"))
    else:
        df = _with_edits(df, edits).select("doc_id", "text", "edits")
    return _apply(df, shared, with_text)


def _apply(df: DataFrame, shared, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(shared)
        for pdf in batches:
            rows = []
            for i, t, es in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["edits"].tolist(), strict=True):
                tree = Tree(counter, t or "")
                before = tree.tokens
                es = [] if es is None else es
                for e in es:
                    tree.edit(int(e["start"]), int(e["end"]), e["new"])
                rows.append((None if i != i else i, before, tree.tokens, len(es), tree.encoded, *([tree.text] if with_text else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_encoded", *(["text"] if with_text else [])], dtype=object)

    return df.mapInPandas(run, "doc_id long, n_tokens long, n_tokens_edited long, n_edits long, n_encoded long" + (", text string" if with_text else ""))


def standard_edits(text):
    """The edits of the registered query, from a text's length alone: an insertion in the
    middle, a deletion at a quarter, a replacement at three quarters."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    half, quarter = F.floor(n / 2), F.floor(n / 4)
    edit = lambda seq, a, b, new: F.struct(F.lit(seq).cast("long").alias("seq"), a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(new).alias("new"))
    return F.array(edit(1, half, half, " and so on"), edit(2, quarter, quarter + 20, ""), edit(3, 3 * quarter, 3 * quarter + 10, "New line.\n"))


def op3_tokencounts(spark, sf_dir):
    shared = _vocabulary(spark, None, None)
    docs = table(spark, sf_dir, "documents")
    return _apply(docs.select("doc_id", "text", standard_edits(F.col("text")).alias("edits")), shared, False)
