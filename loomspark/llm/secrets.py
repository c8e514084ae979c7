"""Operator 9: secret scans with character Markov models.

Base spans come from fixed patterns (assignments, access keys, hexadecimal runs).  On top of
these, two first-order Markov models over characters, one trained on random strings and one
on ordinary identifiers and words, judge every other run of 16 key characters and more: a
log-likelihood ratio per character above a threshold, set on labelled samples too, makes it a
span of kind ``markov``.  Base spans always stay; markov spans never overlap them.

Positions without Python: a pattern's matches and the pieces that a split by the same pattern
leaves alternate, so running lengths of both give every start in code points.  Running sums are
made in blocks of about sqrt(m) entries, so that m spans cost m^1.5 short steps at most and the
characters of a text are walked a fixed number of times.

Scale: one map over the texts; no shuffle, no join.  Cheap containment tests keep the costly
patterns off texts that cannot match.  The models are a table of 95 x 95 numbers, trained on
labelled samples (a parameter; by default made by rule) and put into the plan as a literal.

Defined results: null and empty texts have no spans; a very long run is one span; spans that
start at one place are in the order of kinds; rows are kept as they are, repeated ones
included; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import log
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OTHER = r"[A-Za-z0-9+/_=-]{16,}"
#: The least ratio that makes a span, and the share of ordinary samples that may exceed it.
THRESHOLD, FALSE_ALARMS = 0.5, 0.001
SAMPLES = 6000
SIDE = 95  # printable ASCII, space first

#: Parts of ordinary identifiers.
PARTS = (
    "get set user name list item value index count total order date time file path config "
    "build test run main class method handler request response server client session cache "
    "table column row query result error message status code type data input output buffer "
    "stream reader writer parser token node tree graph edge vertex list map key entry field "
    "record version update create delete insert select filter group merge split join sort "
    "open close start stop begin end first last next previous parent child root leaf width "
    "height color image page view model control event listener thread process task queue job"
).split()


#: Common words and endings of four languages, for compounds without a separator.
WORDS = (
    "the and tion ing that with ent ion ther this have from they will would there their what about which when make like time just know take people into year your good some could them "
    "see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most "
    "les des est que une dans pour pas plus par sur avec tout faire mais nous leur bien sans deux même aussi autre comme ment eau aux ique eur euse entre depuis encore "
    "der die und den das von sie ist des sich mit dem ein eine nicht auch auf werden aus hat dass nach wird bei einer noch wie über einem keit heit lich isch ung schaft zeit leben "
    "los del las por con una para como pero sus este entre cuando todo esta ser son dos también fue había era muy años hasta desde ción mente dad ando iendo ado oso"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES, salt: int = 0) -> DataFrame:
    """(text, label): ``n`` random strings (1), ``n`` identifiers and ``n`` compounds of words (0), by rule."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [digits + "abcdef", upper + digits, upper + lower + digits, upper + lower + digits + "+/_-", upper + lower, lower + digits]
    draw = lambda i, name: F.pmod(F.xxhash64(F.col("id"), i, F.lit(f"{name}{salt}")), F.lit(1 << 40))
    letters = F.element_at(F.array(*[F.lit(a) for a in alphabets]), (F.col("id") % len(alphabets) + 1).cast("int"))
    rand = F.array_join(F.transform(F.sequence(F.lit(1), (F.lit(16) + draw(F.lit(0), "len") % 25).cast("int")), lambda i: F.substring(letters, (draw(i, "char") % F.length(letters) + 1).cast("int"), F.lit(1))), "")

    def made(held: list[str], least: int, name: str):
        words = F.array(*[F.lit(p) for p in held])
        part = lambda i: F.element_at(words, (draw(i, name) % len(held) + 1).cast("int"))
        return F.transform(F.sequence(F.lit(1), (F.lit(least) + draw(F.lit(0), name + "n") % 4).cast("int")), lambda i: F.when(F.col("id") % 3 == 0, F.initcap(part(i))).otherwise(part(i)))

    ident = F.concat(F.array_join(made(PARTS, 2, "word"), "_"), F.when(draw(F.lit(0), "num") % 3 == 0, (draw(F.lit(0), "n") % 3000).cast("string")).otherwise(F.lit("")))
    ident = F.when(F.col("id") % 3 == 0, F.replace(ident, F.lit("_"), F.lit(""))).when(F.col("id") % 3 == 1, F.replace(ident, F.lit("_"), F.lit("-"))).otherwise(ident)
    compound = F.lower(F.array_join(made(WORDS, 4, "part"), ""))
    compound = F.when(F.col("id") % 4 == 0, F.upper(compound)).when(F.col("id") % 4 == 1, F.concat(F.upper(F.substring(compound, 1, 1)), F.substring(compound, 2, 999))).otherwise(compound)
    base = spark.range(n, numPartitions=1)
    return base.select(rand.alias("text"), F.lit(1).alias("label")).unionByName(base.select(ident.alias("text"), F.lit(0).alias("label"))).unionByName(base.select(compound.alias("text"), F.lit(0).alias("label")))


def _codes(text):
    """Rows and columns of a text's characters in the models; others than ASCII are space."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(F.ascii(c).between(33, 126), F.ascii(c) - 32).otherwise(0))


def _pairs(text):
    codes = _codes(text)
    return F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: a * SIDE + b)


def ratio(text, ratios):
    """Log-likelihood ratio per pair of characters, random against ordinary."""
    return F.aggregate(_pairs(text), F.lit(0.0), lambda acc, p: acc + F.get(ratios, p)) / F.greatest(F.length(text) - 1, F.lit(1))


def literal(ratios: list[float]):
    """The model as one folded literal."""
    return F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of the SIDE x SIDE character pairs, random against ordinary."""
    pairs = samples.filter("length(text) > 1 and label in (0, 1)").select("label", F.explode(_pairs(F.col("text"))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.sum(F.col("label")).alias("n1"), F.sum(1 - F.col("label")).alias("n0")).collect()  # at most SIDE * SIDE rows
    n = [[0.0] * (SIDE * SIDE), [0.0] * (SIDE * SIDE)]
    for r in counts:
        n[0][r["pair"]], n[1][r["pair"]] = float(r["n0"]), float(r["n1"])
    sums = [[sum(m[a * SIDE : (a + 1) * SIDE]) for a in range(SIDE)] for m in n]
    chance = [[log((m[a * SIDE + b] + 0.5) / (s[a] + 0.5 * SIDE)) for a in range(SIDE) for b in range(SIDE)] for m, s in zip(n, sums, strict=True)]
    return [x - y for x, y in zip(chance[1], chance[0], strict=True)]


def threshold(samples: DataFrame, ratios: list[float], share: float = FALSE_ALARMS) -> float:
    """The least ratio, ``THRESHOLD`` at least, that no more than ``share`` of the ordinary samples exceed."""
    found = samples.filter("label = 0 and length(text) >= 16").agg(F.percentile(ratio(F.col("text"), literal(ratios)), 1 - share).alias("x")).first()["x"]
    return max(THRESHOLD, found or 0.0)


def running(values):
    """Sums of an array of integers up to and with each entry.

    Blocks of about sqrt(m) entries are summed each, then moved by what stands before them.
    """
    step = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
    block = lambda g: F.aggregate(F.slice(values, g * step + 1, step), F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out")))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / step).cast("int") - 1, F.lit(0))), block)
    kind = "struct<at:int,out:array<array<int>>>"
    moved = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out")).cast(kind), lambda acc, b: F.struct((acc["at"] + b["sum"]).alias("at"), F.concat(acc["out"], F.array(F.transform(b["out"], lambda x: x + acc["at"]))).alias("out")).cast(kind))
    return F.when(F.size(values) > 0, F.flatten(moved["out"])).otherwise(F.array().cast("array<int>"))


def _spans(df: DataFrame, name: str, pattern: str, rank: int, gate) -> DataFrame:
    """``df`` with ``name``: array of (s, rank, e, kind, v) of a pattern's matches in ``t``."""
    none = F.array().cast("array<string>")
    found, rest = F.regexp_extract_all("t", F.lit(pattern), F.lit(0)), F.split("t", pattern, -1)
    df = df.withColumn("found", F.when(gate, found).otherwise(none))
    # a text without a match needs no split
    df = df.withColumn("rest", F.when(F.size("found") > 0, rest).otherwise(none))
    df = df.withColumn("sizes", F.zip_with("found", F.slice("rest", F.lit(1), F.size("found")), lambda f, r: F.length(f) + F.length(r)))
    df = df.withColumn("ends", running(F.col("sizes")))
    spans = F.zip_with("found", "ends", lambda f, e: F.struct((e - F.length(f)).alias("s"), F.lit(rank).alias("rank"), e.alias("e"), F.lit(name).alias("kind"), f.alias("v")))
    return df.withColumn(name, spans).drop("found", "rest", "sizes", "ends")


def _free(df: DataFrame) -> DataFrame:
    """``df`` with those of the disjoint spans ``other`` that no span of ``base`` overlaps.

    As many base spans must end up to a span's start as start before its end: running counts
    over the sorted starts and ends of both.
    """
    event = lambda at, order, start, end, mine: F.struct(at.alias("at"), F.lit(order).alias("order"), F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(mine).alias("mine"))
    events = F.concat(
        F.transform("base", lambda b: event(b["e"], 0, 0, 1, 0)),
        F.transform("other", lambda o: event(o["s"], 1, 0, 0, 1)),
        F.transform("other", lambda o: event(o["e"], 2, 0, 0, 2)),
        F.transform("base", lambda b: event(b["s"], 3, 1, 0, 0)),
    )
    both = (F.size("base") > 0) & (F.size("other") > 0)
    df = df.withColumn("events", F.when(both, F.array_sort(events)))
    df = df.withColumn("starts", running(F.col("events.start"))).withColumn("stops", running(F.col("events.end")))
    df = df.withColumn("events", F.arrays_zip(F.col("events.mine").alias("mine"), "starts", "stops"))
    before = F.transform(F.filter("events", lambda x: x["mine"] == 1), lambda x: x["stops"])
    begun = F.transform(F.filter("events", lambda x: x["mine"] == 2), lambda x: x["starts"])
    df = df.withColumn("clear", F.zip_with(before, begun, lambda x, y: x == y))
    kept = F.transform(F.filter(F.arrays_zip("other", "clear"), lambda x: x["clear"]), lambda x: x["other"])
    return df.withColumn("free", F.when(both, kept).otherwise(F.col("other"))).drop("events", "starts", "stops", "clear", "other")


def _line(spans):
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[float], least: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov for every row."""
    df = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    t, low = F.col("t"), F.lower("t")
    gate = reduce(or_, [low.contains(k) for k in KEYS])
    df = _spans(df, "assign", ASSIGN, 0, gate)
    df = df.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["v"], "^" + ASSIGN, 2)) >= 12))
    df = _spans(df, "access", ACCESS, 1, t.contains("AKIA"))
    df = _spans(df, "hex", HEX, 2, F.lit(True))
    df = _spans(df, "markov", OTHER, 3, F.lit(True)).withColumnRenamed("markov", "other").drop("t")
    df = _free(df.withColumn("base", F.concat("assign", "access", "hex")))
    # only the few rows with a free run walk through the model
    df = df.withColumn("markov", F.filter("free", lambda o: ratio(o["v"], literal(ratios)) > least))
    line = _line(F.col("base"))
    return df.select("doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), F.sha2(line, 256).alias("base_sha256"), _line(F.concat("base", "markov")).alias("spans"), F.size("markov").cast("long").alias("n_markov"))


def op9_secrets(spark, sf_dir):
    samples = labelled_samples(spark)
    ratios = train(samples)
    return scan(table(spark, sf_dir, "documents"), ratios, threshold(labelled_samples(spark, salt=1), ratios))
