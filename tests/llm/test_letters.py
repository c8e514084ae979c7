"""One definition of a letter, however long a text is."""

from loomspark.llm import quality


def test_letters():
    at = quality.FIELDS.index("n_letters")
    for t in ["é", "a — 1", "“a” €5 ß Ж 日本 😀 ok no", "one two three four — “five” €6 ß Ж 日本 😀 \ud800"]:
        assert quality.measure(t)[at] == sum(map(str.isalpha, t)), t
