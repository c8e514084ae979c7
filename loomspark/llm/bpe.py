"""Operator 7: exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For a word (a pre-token with its end-of-word mark) the encoding of each prefix ends in one
certain token.  It is the one token that (a) is a suffix of the prefix and (b) is compatible
with the last token of what stands before it: the two side by side are what the merge rules
give for their joined symbols.  So one table, the last token of every prefix, is filled from
left to right and the ids are read off by following it back.

* Suffix matches come from an automaton over the vocabulary that reports, at every end
  position, all tokens that end there.
* Compatibility of a pair is decided by replaying the merge rules on the pair's symbols and
  is remembered.

Words and pairs are remembered in two generations of bounded size: when the later one is full,
it becomes the earlier one, and what is met again moves on.  So frequent words are never
forgotten, however many rare ones pass, and the work per text is one look-up for most words.

Scale: no shuffle; a map over the texts.  The vocabulary (a few MB, one file whose path is a
parameter) is read on the driver and broadcast; executors need no file.

Defined results: null and empty texts have no ids and decode to the empty text; rows are kept
as they are, repeated ones included; an empty table gives no rows; a very long text is encoded
word by word, a longest word by itself; there are no ties, since each prefix has one last token;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "word_bpe_49k.json"
#: Words, and pairs of tokens, that one generation remembers.
MOST_REMEMBERED = 150_000
MOST_PAIRS = 150_000
#: Longer words are encoded each time.
LONGEST_REMEMBERED = 64
MARK = 0x1000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Remembered(dict):
    """Results of ``make`` for the keys met lately: two generations of at most ``most`` keys."""

    def __init__(self, make: Callable, most: int, keep: Callable = lambda key: True) -> None:
        self.make, self.most, self.keep, self.earlier = make, most, keep, {}

    def __missing__(self, key):
        known = self.earlier.get(key)
        if known is None:
            known = self.make(key)
            if not self.keep(key):
                return known
        if len(self) >= self.most:
            self.earlier = dict(self)
            self.clear()
        self[key] = known
        return known


class PrefixCoder:
    """Encoder for a vocabulary file whose words end in a marked symbol."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.strings = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.decimal = {i: str(i) for i in self.strings}
        self.symbol = byte_symbols()
        self.content = content
        self.library = None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.word = regex.compile(next(x["pattern"]["Regex"] for x in steps if x["type"] == "Split"))
        # the same pattern with its classes spelt out for the characters up to U+024F and what
        # normalising makes of them: the standard module is faster
        few = sorted({x for c in range(0x250) for x in (chr(c), *unicodedata.normalize("NFC", chr(c)).lower())})
        space = "\t\n\v\f\r \x85\xa0"
        letter, number = ("".join(c for c in few if unicodedata.category(c)[0] == k) for k in "LN")
        spelt = self.word.pattern.replace("\\s", space).replace("\\p{L}", re.escape(letter)).replace("\\p{N}", re.escape(number))
        self.fast = re.compile(spelt)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # one character per symbol, the marked last one included, so that positions agree:
        # a marked symbol is its character moved up by MARK
        self.tokens: dict[str, tuple[int, tuple[str, ...]]] = {}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            parts = self._parts(s)
            if parts and self._replay(parts) == [s]:
                key = self._packed(parts)
                self.automaton.add_word(key, (len(parts), i))
                self.tokens[i] = parts
        self.automaton.make_automaton()
        self.pairs = Remembered(lambda pair: self.compatible(pair >> 20, pair & 0xFFFFF), MOST_PAIRS)
        self.words = Remembered(self.encode_word, MOST_REMEMBERED, lambda word: len(word) <= LONGEST_REMEMBERED)

    def _parts(self, token: str) -> tuple[str, ...]:
        """A token's symbols; the last one carries the end mark if the token does."""
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return (*body[:-1], body[-1] + self.end)
        return tuple(token)

    def _packed(self, parts: tuple[str, ...] | list[str]) -> str:
        return "".join(x if len(x) == 1 else chr(ord(x[0]) + MARK) for x in parts)

    def _replay(self, parts) -> list[str]:
        """The merge rules applied to symbols, lowest rank first, leftmost first."""
        parts, rank, none = list(parts), self.rank.get, 1 << 30
        while len(parts) > 1:
            ranks = [rank(pair, none) for pair in pairwise(parts)]
            if (best := min(ranks)) == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        return self._replay((*self.tokens[a], *self.tokens[b])) == [self.strings[a], self.strings[b]]

    def encode_word(self, word: str) -> tuple[int, ...]:
        if not (word.isascii() and word.isprintable()):
            word = word.encode("utf-8").decode("latin-1").translate(self.symbol)
        return self._encode_packed(word[:-1] + chr(ord(word[-1]) + MARK) if self.end else word)

    def _encode_packed(self, packed: str) -> tuple[int, ...]:
        last, pairs = [None] * len(packed), self.pairs
        for at, match in self.automaton.iter(packed):
            if last[at] is None:
                length, token = match
                if at >= length and ((before := last[at - length]) is None or not pairs[before[1] << 20 | token]):
                    continue
                last[at] = match
        ids, at = [], len(packed) - 1
        while at >= 0:
            length, token = last[at]
            ids.append(token)
            at -= length
        return tuple(ids[::-1])

    def _split(self, text: str) -> list[str]:
        """The words of a normalised text, as strings of byte symbols.

        Unicode tables differ between versions.  Up to U+024F they agree; texts with other
        characters are normalised and split by the library's own components, so that only
        the version of its tables counts.
        """
        if _AGREED.fullmatch(text):
            return self.fast.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.content)
            self.byte = {c: b for b, c in enumerate(self.symbol)}
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, w)).decode("utf-8") for w, _ in words]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for k, piece in enumerate(self.cut.split(text) if self.cut and text else [text]):
            if k % 2:
                out.append(self.special[piece])
            elif piece:
                out += chain.from_iterable(map(self.words.__getitem__, self._split(piece)))
        return out

    def digits(self, ids: list[int]) -> str:
        """Decimal ids joined by single spaces."""
        return " ".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by single spaces, unknown ids left out."""
        strings = self.strings
        return " ".join([strings[i] for i in ids if i in strings])


_AGREED = regex.compile(r"[\x00-\u024F]*")
_coders: dict[str, PrefixCoder] = {}


def coder(content: str) -> PrefixCoder:
    """One coder per worker process and vocabulary."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _coders:
        _coders[key] = PrefixCoder(content)
    return _coders[key]


def read_vocabulary(path: str | None = None) -> str:
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded) for every row."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(shared.value)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        width = 6 if with_ids else 4
        for batch in batches:
            columns = [[] for _ in range(width)]
            # one text at a time is a Python string
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ids = c.encode(t.as_py())
                decoded = c.decode(ids)
                row = (i.as_py(), len(ids), hashlib.sha256(c.digits(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                for column, value in zip(columns, (*row, ids, decoded) if with_ids else row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types[:width], strict=True)], names[:width])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op7_bpe(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"))
