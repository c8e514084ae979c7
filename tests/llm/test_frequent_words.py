"""op7 encodes frequent words once, however many rare ones pass, and remembers a bounded number."""

from collections import Counter

import public_tokenizers as P
from tokenizers import Tokenizer

from loomspark.llm import bpe


def test_frequent_words_are_encoded_once(monkeypatch):
    encoded, real = Counter(), bpe.PrefixCoder.encode_word
    monkeypatch.setattr(bpe.PrefixCoder, "encode_word", lambda self, word: encoded.update([word]) or real(self, word))
    monkeypatch.setattr(bpe, "MOST_REMEMBERED", 50)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 50)
    c = bpe.PrefixCoder(bpe.read_vocabulary())
    rare = ["q" + "".join(chr(97 + int(d)) for d in str(k)) for k in range(2_000)]
    texts = [f"the ß of{'z' * 65} and " + " ".join(rare[k : k + 20]) for k in range(0, 2_000, 20)]
    t = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    assert [c.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [encoded[x] for x in ("the", "ß", "and")] == [1, 1, 1]
    assert len(c.words) <= 50 and len(c.pairs) <= 50
    assert not [x for x in c.words if len(x) > 64]
