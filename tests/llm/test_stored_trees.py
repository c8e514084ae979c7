"""Token counts: trees that are stored, edited and stored again."""

import random

import public_tokenizers as P
from loomspark.llm import tokencount
from test_operators import words


def test_second_run_encodes_only_what_edits_touch(spark, tmp_path):
    rows = [(i, " ".join(words(400 + 50 * i, 40 + i)) + ".") for i in range(6)] + [(6, ""), (7, None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokencount.plant(docs).write.parquet(str(tmp_path / "0"))
    with open(P.path(tokencount.VOCABULARY), "rb") as f:
        counter = tokencount.Counter(f.read(), P.PATTERN)
    texts, r = {i: t or "" for i, t in rows}, random.Random(3)
    for turn in range(2):
        edits = []
        for i in (1, 3, 6, 7, 99):
            t = texts.get(i, "")
            a = r.randrange(len(t) + 1)
            edits.append((i, turn, a, a + 3, " new's word"))
            if i in texts:
                texts[i] = t[:a] + " new's word" + t[a + 3 :]
        stored = spark.read.parquet(str(tmp_path / str(turn)))
        tokencount.edit_stored(stored, spark.createDataFrame(edits, "doc_id long, seq long, start long, end long, new string")).write.parquet(str(tmp_path / str(turn + 1)))
        got = {x.doc_id: x for x in spark.read.parquet(str(tmp_path / str(turn + 1))).collect()}
        assert len(got) == len(rows)
        for i, x in got.items():
            assert x.text == texts[i] and x.n_tokens == sum(x.counts) == len(counter.coding.encode_ordinary(x.text)) and sum(x.lengths) == len(x.text)
            assert x.n_encoded < 20 if i in (1, 3, 6, 7) else x.n_encoded == 0
    assert tokencount.plant(docs.limit(0)).count() == 0


def test_counters_of_two_vocabularies():
    class Shared:
        def __init__(self, *value):
            self.value = value

    with open(P.path(tokencount.VOCABULARY), "rb") as f:
        content = f.read()
    one, two = tokencount._counter(Shared(content, P.PATTERN)), tokencount._counter(Shared(content, r"\S+|\s+"))
    assert one is not two and tokencount._counter(Shared(content, r"\S+|\s+")) is two
