"""op7 equals the tokenizers library at every code point of the first plane, alone and in company."""

import random

import public_tokenizers as P
from tokenizers import Tokenizer

from loomspark.llm import bpe


def test_every_code_point():
    t = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    t.no_truncation()
    t.no_padding()
    c = bpe.PrefixCoder(bpe.read_vocabulary())
    points = [chr(x) for x in range(0x10000) if not 0xD800 <= x < 0xE000]
    rng = random.Random(3)
    texts = points + [f"a{x}b {x}" for x in points[:0x250]] + ["".join(rng.choices(points[:0x250], k=12)) for _ in range(3000)] + ["".join(rng.choices(points, k=8)) for _ in range(2000)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [x for x, w in zip(texts, want, strict=True) if c.encode(x) != w] == []
