"""English stems by the Snowball algorithm, as expressions over a column of words.

A word is worked on by a chain of projections: the regions R1 and R2 are two numbers, each step
finds the longest of its suffixes by one anchored alternation (the leftmost match is the
longest) and changes the word if the suffix lies in its region.  Meant for distinct words: a
vocabulary is stemmed once and joined, not each occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words with stems of their own.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
#: Words that stay, at once and after their plural is cut.
INVARIANT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
INVARIANT_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Suffixes and what they become, in R1 (step 2, step 3) and R2 (step 4).
STEP_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
#: Beginnings after which R1 starts whatever follows.
HEADS = ("gener", "commun", "arsen")
#: English stop words.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
 it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being
 have has had having do does did doing a an the and but if or because as until while of at by for with about against between
 into through during before after above below to from up down in out on off over under again further then once here there
 when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
 just don should now""".split()

# a y that is a consonant is written Y
_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_REGION = f"{_OTHER}*{_VOWEL}+{_OTHER}"
_SHORT = f"(^{_VOWEL}{_OTHER}|{_OTHER}{_VOWEL}[^aeiouywxY])$"


def _literal(table: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def with_stems(words: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """``words`` with the stem of each lower-case word; words of two letters and fewer stay.

    The columns ``__w``, ``__p1``, ``__p2`` and ``__s`` are used on the way."""
    w, p1, p2, s = (F.col(f"__{x}") for x in ("w", "p1", "p2", "s"))
    without = lambda n: F.left(w, F.length(w) - n)
    base = F.left(w, F.length(w) - F.length(s))
    within = lambda p: F.length(w) - F.length(s) >= p
    ends = lambda *suffixes: F.regexp_extract(w, f"({'|'.join(suffixes)})$", 1)
    step = lambda df, change, suffix=None: (df if suffix is None else df.withColumn("__s", suffix)).withColumn("__w", change)

    out = words.withColumn("__w", F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "^'", ""), "^y", "Y"), f"({_VOWEL})y", "$1Y"))
    region = F.length(F.regexp_extract(w, f"^({'|'.join(HEADS)}|{_REGION})", 1))
    out = out.withColumn("__p1", F.when(region == 0, F.length(w)).otherwise(region))
    region = F.length(F.regexp_extract(F.substr(w, p1 + 1), f"^({_REGION})", 1))
    out = out.withColumn("__p2", F.when(region == 0, F.length(w)).otherwise(p1 + region))
    # 0: genitives; 1a: plurals
    out = step(out, F.regexp_replace(w, "('s'|'s|')$", ""))
    out = step(out, F.when(w.endswith("sses"), without(2)).when(w.rlike("ie[ds]$"), F.when(F.length(w) > 4, without(2)).otherwise(without(1))).when(w.rlike("[us]s$"), w).when(w.rlike(f"{_VOWEL}.+s$"), without(1)).otherwise(w))
    out = out.withColumn("__fixed", w.isin(*INVARIANT_1A))
    # 1b: past tenses and participles
    out = out.withColumn("__s", ends("eedly", "ingly", "edly", "eed", "ing", "ed"))
    repaired = F.when(base.rlike("(at|bl|iz)$"), F.concat(base, F.lit("e"))).when(base.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.left(base, F.length(base) - 1)).when((F.length(base) <= p1) & base.rlike(_SHORT), F.concat(base, F.lit("e"))).otherwise(base)
    out = step(out, F.when(s == "", w).when(s.startswith("eed"), F.when(within(p1), F.concat(base, F.lit("ee"))).otherwise(w)).when(base.rlike(_VOWEL), repaired).otherwise(w))
    # 1c: y to i behind a consonant
    out = step(out, F.regexp_replace(w, f"^(.+{_OTHER})[yY]$", "$1i"))
    # 2 and 3: suffixes in R1
    allowed = F.when(s == "ogi", base.endswith("l")).when(s == "li", base.rlike("[cdeghkmnrt]$")).otherwise(F.lit(True))
    out = step(out, F.when((s != "") & within(p1) & allowed, F.concat(base, F.element_at(_literal(STEP_2), s))).otherwise(w), ends(*STEP_2))
    out = step(out, F.when((s != "") & within(p1) & ((s != "ative") | within(p2)), F.concat(base, F.element_at(_literal(STEP_3), s))).otherwise(w), ends(*STEP_3))
    # 4: suffixes in R2
    out = step(out, F.when((s != "") & within(p2) & ((s != "ion") | base.rlike("[st]$")), base).otherwise(w), ends(*STEP_4))
    # 5: a last e or l
    out = step(out, F.when((s == "e") & (within(p2) | (within(p1) & ~base.rlike(_SHORT))), base).when((s == "l") & within(p2) & base.endswith("l"), base).otherwise(w), ends("e", "l"))
    # __fixed words have kept their letters: the later steps are undone
    cut = F.regexp_replace(F.regexp_replace(word, "^'", ""), "('s'|'s|'|s)$", "")
    own = F.element_at(_literal(IRREGULAR), F.col(word))
    plain = F.when(F.length(word) <= 2, F.col(word)).when(F.col(word).isin(*INVARIANT), F.col(word))
    plain = plain.when(own.isNotNull(), own).when(F.col("__fixed"), F.when(F.col(word).isin(*INVARIANT_1A), F.col(word)).otherwise(cut))
    # made by a generator, so that no filter on the stem is pushed into the steps, where it would be written out anew at each
    return out.withColumn(stem, F.explode(F.array(plain.otherwise(F.translate(w, "Y", "y"))))).drop("__w", "__p1", "__p2", "__s", "__fixed")
