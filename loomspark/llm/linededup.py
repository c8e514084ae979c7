"""Operator 6: line dedup by winnowing over line hashes.

A *line* is a piece of text that ends at a line feed or after a punctuation mark (a clause):
passages stand inside of lines, and whole clauses of them can be found.  The pieces of a text
joined again are the text.  Blank pieces do not count.  A line's hash is
that of its trimmed lower-case form and its weight is its number of words.

1. Gram i is the shortest run of lines from i on with ``gram_words`` words or more.
   Winnowing: of all grams that start within the first
   ``window_words`` words from a line on (or its first ``MOST_LINES`` lines), the one whose
   first line has the least hash is a fingerprint of that place.  Any two equal runs of
   whole lines with ``window_words + gram_words - 1`` words or more therefore share a
   fingerprint, at the same place in both, however many lines they have: a window inside
   both has the same lines, and all its grams lie inside as well.
2. A fingerprint that stands at two places or more marks them (a partial aggregate and an
   equi-join; no pairs).  A repeated run of ``min_words`` words or more holds a marked place.
3. Two runs with ``min_words`` words or more belong to each line: the shortest from it on and
   the shortest up to it.  Those with a marked place in them are hashed whole, each once, and
   looked up by that key: every run but the one at the earliest place (doc_id, then line
   number) repeats an earlier place.  Any longer repeated run is the union of such runs, so
   that all repeated runs are found, whatever else their fingerprints stand in.
4. Such runs go; the earliest place of each stays.  Runs that overlap or follow on each other
   are one, with the blank pieces between.  What stays is the text without these pieces.

Scale: fingerprints are (long, long, int) rows, about two for three lines, and runs are rows
of six numbers, at most two for a line near a marked place: a passage in a third of all
documents costs rows for each, not a pair for each two.  The text itself is shuffled once at
most, to meet the runs to delete.  Line hashes of documents are stored once in the shared
folder; all joins are equi-joins that AQE can split.

Defined results: null text stays null and empty text empty, both without lines; equal
documents: the smallest doc_id keeps its text, the others lose all lines of a repeated run;
rows that repeat a doc_id are told apart by their text, and identical rows are one document
(all copies get the same result); other columns are passed through, but an input column n_cut
is replaced; a very long text or many equal lines cost two rows a line, and an empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, table

GRAM_WORDS = 15
WINDOW_WORDS = 15
MIN_WORDS = 30
#: A window has so many lines at most; a shorter one keeps the guarantee.
MOST_LINES = 4

#: A piece ends after a line feed, or after a punctuation mark of ASCII before white space.
#: (The first part alone rules out most places.)
MARKS = r"!-/:-@\[-`{-~"
BORDER = rf"(?<=[\n{MARKS}])(?:(?<=\n)|(?=[\x20\x09\x0B-\x0D]))"
#: The same borders where single spaces and line feeds alone are white space, and none of them
#: stands beside another: the white space at the border itself.
PLAIN_BORDER = rf"[\n\x20](?<![^{MARKS}]\x20)"


def pieces(text):
    return F.split(F.coalesce(text, F.lit("")), BORDER)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, mark, at (piece numbers), h (hashes), n (weights) of the lines of each text.

    A text without lines has empty arrays.
    """
    # in most texts no white space stands beside another: their lines need no trimming, and the
    # number of spaces says the number of words
    gaps = ["  ", " \n", "\n ", "\t", "\r", "\f", "\x0b"]
    odd = lambda c, gaps=gaps: reduce(or_, [F.contains(c, F.lit(x)) for x in gaps])
    text = F.col("text")
    unusual = odd(text) | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    # no filter on the arrays: it would be pushed down, and the lines be made twice
    df = docs.filter("text is not null and text != ''").select("doc_id", F.xxhash64("text").alias("mark"), F.lower("text").alias("low"), unusual.alias("unusual"))
    df = df.select("doc_id", "mark", "low", F.when(~F.col("unusual"), F.split("low", PLAIN_BORDER)).alias("keys"))
    plain = F.col("keys").isNotNull() & ~F.array_contains("keys", F.lit(""))
    spaces = lambda key: F.octet_length(key) - F.octet_length(F.replace(key, F.lit(" "), F.lit(""))) + 1
    words = lambda key: F.when(odd(key, ["  ", "\t", "\r", "\f", "\x0b"]), F.size(F.split(key, r"[\x20\x09-\x0D]+"))).otherwise(spaces(key))
    blank = F.lit(" \t\n\r\f\x0b")
    full = F.transform(pieces(F.col("low")), lambda p, i: F.struct(i.alias("at"), F.trim(p, blank).alias("key")))
    full = F.filter(full, lambda x: x["key"] != "")
    full = F.transform(full, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["key"]).alias("h"), words(x["key"]).alias("n")))
    df = df.select("doc_id", "mark", "keys", F.when(plain, F.lit(None)).otherwise(full).alias("full"))
    plain = F.col("full").isNull()
    at = F.when(plain, F.sequence(F.lit(0), F.size("keys") - 1)).otherwise(F.col("full.at"))
    h = F.when(plain, F.transform("keys", lambda key: F.xxhash64(key))).otherwise(F.col("full.h"))
    n = F.when(plain, F.transform("keys", spaces)).otherwise(F.col("full.n"))
    return df.select("doc_id", "mark", at.alias("at"), h.alias("h"), n.alias("n"))


def _where(rows: DataFrame, condition, value, name: str) -> DataFrame:
    """``rows`` that meet ``condition``, with ``value`` as ``name``: a filter that the optimizer
    doesn't push below the projections, where their expressions would be written out again."""
    return rows.select("*", F.explode(F.when(condition, F.array(value))).alias(name))


def fingerprints(lines: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """fp, doc_id, mark, pos: the window minima of every document's grams.

    One generated loop over the lines, each of which looks at its neighbours in the arrays.
    """
    own = ["doc_id", "mark", "h", "n"]
    near = lambda c, k, base="i": F.get(F.col(c), F.col(base) + k)
    rows = lines.select(*own, F.posexplode("h").alias("i", "h0"))
    ahead = [near("h", k).alias(f"h{k}") for k in range(1, MOST_LINES)]
    sizes = [F.coalesce(near("n", k), F.lit(0)).alias(f"n{k}") for k in range(MOST_LINES - 1)]
    rows = rows.select(*own, "i", "h0", *ahead, *sizes, near("h", -1).alias("hb"), F.coalesce(near("n", -1), F.lit(0)).alias("nb"))

    def least(first, sums):
        return F.least(first[0], *[F.when(w < window_words, h) for h, w in zip(first[1:], sums, strict=True)])

    h = [F.col(f"h{k}") for k in range(MOST_LINES)]
    sums = [sum((F.col(f"n{j}") for j in range(1, k + 1)), F.col("n0")) for k in range(MOST_LINES - 1)]
    before = [F.col("nb"), *[F.col("nb") + x for x in sums[:-1]]]
    rows = rows.select(*own, "i", *[f"h{k}" for k in range(MOST_LINES - 1)], "hb", least(h, sums).alias("best"), least([F.col("hb"), *h[:-1]], before).alias("best_before"))
    offset = F.when(F.col("best") == F.col("h0"), 0)
    for k in range(1, MOST_LINES - 1):
        offset = offset.when(F.col("best") == F.col(f"h{k}"), k)
    # none where the window of the line before has the same minimum: it is given already
    new = (F.col("i") == 0) | (F.col("best") != F.col("best_before")) | (F.col("best_before") == F.col("hb"))
    rows = rows.select(*own, "i", new.alias("new"), offset.otherwise(MOST_LINES - 1).alias("offset"))
    rows = _where(rows, F.col("new"), F.col("i") + F.col("offset"), "pos")
    rows = rows.select("doc_id", "mark", "pos", "h", "n", F.xxhash64(near("h", 0, "pos")).alias("x0"), near("n", 0, "pos").alias("w0"))
    for k in range(1, gram_words):  # a line has a word at least
        rows = rows.select("*", F.xxhash64(f"x{k - 1}", near("h", k, "pos")).alias(f"x{k}"), (F.col(f"w{k - 1}") + near("n", k, "pos")).alias(f"w{k}"))
    gram = F
    for k in range(gram_words):
        gram = gram.when(F.col(f"w{k}") >= gram_words, F.col(f"x{k}"))
    rows = rows.select("doc_id", "mark", "pos", gram.alias("gram"))
    return _where(rows, F.col("gram").isNotNull(), F.col("gram"), "fp").select("fp", "doc_id", "mark", "pos")


def long_runs(marked: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """run, doc_id, mark, s, e, a, b: hash, lines [s, e) and pieces [a, b) of the shortest runs
    from each line on and up to each line that hold a place of ``marked``.

    ``marked``: doc_id, mark, at, h, n and the sorted line numbers ``seen``.
    """
    # sums of 1, 2, 4, ... lines from each line on (null beyond the end): a run's length follows in
    # a few steps, the longest first (a line has a word at least)
    steps = [1]
    while 2 * steps[-1] < min_words:
        steps.append(2 * steps[-1])
    own = ["doc_id", "mark", "at", "h", "next", *[f"s{k}" for k in steps]]
    # for every line up to the last marked one, the first marked line from it on
    gap = lambda p, k: F.array_repeat(p, p - F.coalesce(F.get("seen", k - 1), F.lit(-1)))
    rows = marked.select("doc_id", "mark", "at", "h", F.col("n").alias("s1"), F.flatten(F.transform("seen", gap)).alias("next"))
    for k in steps[1:]:
        half = f"s{k // 2}"
        rows = rows.withColumn(f"s{k}", F.zip_with(half, F.slice(half, F.lit(k // 2 + 1), F.size("s1")), lambda x, y: x + y))
    # generated code from here on: a row looks at its neighbours in the document's arrays, in the
    # one way and in the other
    rows = rows.select(*own, F.posexplode("s1").alias("i", "n0"))
    rows = rows.select(*own, "i", F.coalesce("n0", F.lit(0)).alias("n0"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("way"))
    rows = rows.select(*own, "i", "n0", "way", F.lit(0).alias("sum"), F.lit(0).alias("k"))
    held = ["i", "n0", "way", "sum", "k"]
    for k in reversed(steps):
        block = F.get(f"s{k}", F.when(F.col("way") == 1, F.col("i") + F.col("k")).otherwise(F.col("i") - F.col("k") - (k - 1)))
        rows = rows.select(*own, *held, (F.col("sum") + block).alias("more"))
        go = F.coalesce(F.col("more") < min_words, F.lit(False))
        rows = rows.select(*own, "i", "n0", "way", F.when(go, F.col("more")).otherwise(F.col("sum")).alias("sum"), F.when(go, F.col("k") + k).otherwise(F.col("k")).alias("k"))
    last = F.coalesce(F.get("s1", F.col("i") + F.col("way") * F.col("k")), F.lit(0))
    rows = rows.select(*own, "i", "n0", "way", (F.col("sum") + last).alias("sum"), (F.col("k") + 1).alias("size"))
    ahead = F.col("way") == 1
    # the shortest run up to a line is left out if it is also the shortest from its start on
    good = (F.col("sum") >= min_words) & (ahead | (F.col("sum") - F.col("n0") >= min_words))
    start = F.when(ahead, F.col("i")).otherwise(F.col("i") + 1 - F.col("size"))
    rows = rows.select("doc_id", "mark", "at", "h", "next", "size", F.when(good, start).alias("s"))
    rows = _where(rows.withColumnRenamed("s", "at_s"), F.get("next", "at_s") < F.col("at_s") + F.col("size"), F.col("at_s"), "s")
    return rows.select(F.xxhash64(F.slice("h", F.col("s") + 1, F.col("size"))).alias("run"), "doc_id", "mark", "s", (F.col("s") + F.col("size")).alias("e"), F.get("at", "s").alias("a"), (F.get("at", F.col("s") + F.col("size") - 1) + 1).alias("b"))


def repeated_runs(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, mark, runs: array of [from, to) piece numbers that repeat an earlier place."""
    if min_words < gram_words + window_words - 1:
        raise ValueError("min_words must be gram_words + window_words - 1 at least")
    lines = materialise(line_table(docs), "lines")
    if not lines.groupBy("doc_id", "mark").count().filter("count > 1").isEmpty():
        once = materialise(lines.dropDuplicates(["doc_id", "mark"]), "lines")
        release(lines)
        lines = once
    prints = materialise(fingerprints(lines, gram_words, window_words), "prints")
    # written, so that the join has a shuffle on either side and AQE can split a frequent key
    often = materialise(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("fp").alias("f_fp")), "often")
    seen = prints.join(often, F.col("fp") == F.col("f_fp")).groupBy(F.col("doc_id").alias("p_doc"), F.col("mark").alias("p_mark")).agg(F.array_sort(F.collect_set("pos")).alias("seen"))
    # a document has one row on either side: hashing the smaller one spares sorting the larger
    marked = lines.join(seen.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("mark") == F.col("p_mark"))).select("doc_id", "mark", "at", "h", "n", "seen")
    runs = materialise(long_runs(marked, min_words), "runs")
    release(lines, prints, often)
    place = F.struct("doc_id", "mark", "s")
    first = runs.groupBy("run").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("run").alias("f_run"), "first")
    first = materialise(first, "first")
    later = runs.join(first, F.col("run") == F.col("f_run")).filter(place > F.col("first"))
    found = later.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("s", "e", "a", "b"))).alias("found"))
    # sorted runs that overlap or follow on each other become one
    joined = F.aggregate(
        F.slice("found", F.lit(2), F.size("found")),
        F.struct(F.get("found", F.lit(0)).alias("now"), F.array().cast("array<struct<a:int,b:int>>").alias("done")),
        lambda acc, x: F.when(
            x["s"] <= acc["now"]["e"],
            F.struct(F.struct(acc["now"]["s"].alias("s"), F.greatest(acc["now"]["e"], x["e"]).alias("e"), acc["now"]["a"].alias("a"), F.greatest(acc["now"]["b"], x["b"]).alias("b")).alias("now"), acc["done"].alias("done")),
        ).otherwise(F.struct(x.alias("now"), F.concat(acc["done"], F.array(F.struct(acc["now"]["a"].alias("a"), acc["now"]["b"].alias("b")))).alias("done"))),
        lambda acc: F.concat(acc["done"], F.array(F.struct(acc["now"]["a"].alias("a"), acc["now"]["b"].alias("b")))),
    )
    return found.select("doc_id", "mark", joined.alias("runs"))


def dedup_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs cut from ``text``, and n_cut (pieces cut)."""
    names = [c for c in docs.columns if c not in ("text", "n_cut")]
    runs = repeated_runs(docs.select("doc_id", "text"), gram_words, window_words, min_words).select(F.col("doc_id").alias("__r_doc"), F.col("mark").alias("__r_mark"), F.col("runs").alias("__runs"))
    out = docs.join(runs.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__r_doc")) & (F.xxhash64("text") == F.col("__r_mark")), "left")
    # columns of their own, so that each is made once a row
    out = out.withColumn("__pieces", F.when(F.col("__runs").isNotNull(), pieces(F.col("text"))))
    p, gaps = F.col("__pieces"), F.col("__gaps")
    # kept stretches between the sorted runs
    stretches = F.aggregate(
        F.concat(F.col("__runs"), F.array(F.struct(F.size(p).alias("a"), F.size(p).alias("b")))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("keep")),
        lambda acc, r: F.struct(F.greatest(acc["at"], r["b"]).alias("at"), F.when(r["a"] > acc["at"], F.concat(acc["keep"], F.array(F.struct(acc["at"].alias("a"), r["a"].alias("b"))))).otherwise(acc["keep"]).alias("keep")),
        lambda acc: acc["keep"],
    )
    out = out.withColumn("__gaps", stretches)
    kept = F.array_join(F.transform(gaps, lambda g: F.array_join(F.slice(p, g["a"] + 1, g["b"] - g["a"]), "")), "")
    cut = F.size(p) - F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g["b"] - g["a"])
    text = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(kept)
    return out.select(*[F.col(c) for c in names], text.alias("text"), F.when(F.col("__runs").isNull(), 0).otherwise(cut).cast("long").alias("n_cut"))


def op6_linededup(spark, sf_dir):
    """doc_id, n_cut, kept_sha256 (of the text that stays, null for null) per document."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_cut", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
