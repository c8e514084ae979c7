"""Queries over versioned memories, retrieval and embedding maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stemmer as ST
from ..functions import text as T
from ..operators import memory as M
from ..operators import search as S
from ..operators import session as P
from ..operators import text_index as IX
from ..sources.shared import fresh_path, numbered
from . import fixtures as X

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


COSINE = "list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(CAST(a.embedding AS DOUBLE[]), lambda v: v * v))) * sqrt(list_sum(list_transform(CAST(q.embedding AS DOUBLE[]), lambda v: v * v))))"


@query("vector_topk", f"WITH {X.EMBEDDINGS}, s AS (SELECT a.id, a.version, {COSINE} AS score FROM emb a, (SELECT embedding FROM emb WHERE id = '0') q) SELECT CAST(row_number() OVER (ORDER BY score DESC, id, version) AS INTEGER) AS rank, id, version, round(score, 6) AS score FROM s ORDER BY 1 LIMIT 10")
def vector_topk(spark, d):
    e = X.embeddings(spark, d)
    return S.vector(e.select("id", "version"), e, X.query_vector(spark, d), 10).withColumn("score", F.round("score", 6))


HEADS = "heads AS (SELECT * FROM memories QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1)"


@query("memory_heads", f"WITH {X.MEMORIES}, {HEADS} SELECT id, version, type, title, content FROM heads")
def memory_heads(spark, d):
    return M.heads(X.memories(spark, d)).drop("concepts")


@query("memory_get_exact", f"WITH {X.MEMORIES} SELECT id, version, type, title, content FROM memories WHERE id = '3' AND version = 2")
def memory_get_exact(spark, d):
    return M.get_exact(X.memories(spark, d), "3", 2).drop("concepts")


@query("memory_get_latest", f"WITH {X.MEMORIES}, {HEADS} SELECT id, version, type, title, content FROM heads WHERE id = '3'")
def memory_get_latest(spark, d):
    return M.get_latest(X.memories(spark, d), "3").drop("concepts")


@query("memory_list_versions", f"WITH {X.MEMORIES}, p AS (SELECT id, version, title, row_number() OVER (ORDER BY version DESC) AS n, count(*) OVER () AS c FROM memories WHERE id = '3') SELECT id, version, title, CAST(n - 1 AS INTEGER) AS position, CASE WHEN c > 3 THEN CAST(3 AS BIGINT) END AS next_offset FROM p WHERE n > 1 AND n <= 3")
def memory_list_versions(spark, d):
    return M.list_versions(X.memories(spark, d), "3", 1, 2).select("id", "version", "title", "position", "next_offset")


@query(
    "memory_insert_outcomes",
    f"WITH {X.MEMORIES}, req AS (SELECT id, version + 2 AS version, row_number() OVER (ORDER BY id, version) AS ordinal FROM memories UNION ALL SELECT id, version + 2, 1000000000 + row_number() OVER (ORDER BY id, version) FROM memories) SELECT r.ordinal, r.id, r.version, CASE WHEN m.id IS NULL AND row_number() OVER (PARTITION BY r.id, r.version ORDER BY r.ordinal) = 1 THEN 'inserted' ELSE 'conflict' END AS outcome FROM req r LEFT JOIN memories m ON m.id = r.id AND m.version = r.version",
)
def memory_insert_outcomes(spark, d):
    m = X.memories(spark, d).select("id", "version")
    m = numbered(m, ["id", "version"], "n")
    n = F.col("n")
    req = m.select("id", (F.col("version") + 2).alias("version"), n.alias("ordinal"))
    req = req.unionByName(m.select("id", (F.col("version") + 2).alias("version"), (n + 1000000000).alias("ordinal")))
    return M.insert_outcomes(m, req).select("ordinal", "id", "version", "outcome")


@query(
    "embedding_insert_outcomes",
    f"WITH {X.CORPUS}, {X.EMBEDDINGS}, req AS (SELECT 3 * vec_id AS ordinal, CAST(3 * vec_id AS VARCHAR) AS id, CAST(1 AS BIGINT) AS version FROM embeddings), held AS (SELECT id, version FROM emb WHERE CAST(id AS BIGINT) % 2 = 0) SELECT r.ordinal, r.id, r.version, CASE WHEN c.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'inserted' ELSE 'conflict' END AS outcome FROM req r LEFT JOIN corpus c ON c.id = r.id AND c.version = r.version LEFT JOIN held e ON e.id = r.id AND e.version = r.version",
)
def embedding_insert_outcomes(spark, d):
    e = X.embeddings(spark, d)
    req = X.read(spark, d, "embeddings").select((F.col("vec_id") * 3).alias("ordinal"), (F.col("vec_id") * 3).cast("string").alias("id"), F.lit(1).cast("long").alias("version"))
    return M.embedding_outcomes(X.corpus(spark, d), e.filter(F.col("id").cast("long") % 2 == 0), req).select("ordinal", "id", "version", "outcome")


@query(
    "embedding_load_keys",
    f"WITH {X.CORPUS}, {X.EMBEDDINGS}, k AS (SELECT c_custkey AS ordinal, CAST(c_custkey * 2 AS VARCHAR) AS id, CAST(1 AS BIGINT) AS version FROM customer) SELECT k.ordinal, k.id, k.version, CASE WHEN c.id IS NULL THEN 'missing' WHEN e.id IS NOT NULL THEN 'already_present' ELSE 'pending' END AS state, CASE WHEN c.id IS NOT NULL AND e.id IS NULL THEN c.title END AS title FROM k LEFT JOIN corpus c USING (id, version) LEFT JOIN emb e USING (id, version)",
)
def embedding_load_keys(spark, d):
    k = X.read(spark, d, "customer").select(F.col("c_custkey").alias("ordinal"), (F.col("c_custkey") * 2).cast("string").alias("id"), F.lit(1).cast("long").alias("version"))
    return M.load_keys(X.corpus(spark, d), X.embeddings(spark, d), k).select("ordinal", "id", "version", "state", "title")


@query("embedding_list_missing", f"WITH {X.CORPUS}, {X.EMBEDDINGS} SELECT c.id, c.version FROM corpus c ANTI JOIN emb e ON e.id = c.id AND e.version = c.version ORDER BY id, version LIMIT 100")
def embedding_list_missing(spark, d):
    return M.list_missing(X.corpus(spark, d), X.embeddings(spark, d), 100)


@query("embedding_render", f"WITH {X.CORPUS}, r AS (SELECT id, version, to_json({{'format': 'v1', 'title': title, 'content': content, 'concepts': [lang]}}) AS j FROM corpus) SELECT id, version, CAST(strlen(j) AS INTEGER) AS input_bytes, CASE WHEN strlen(j) > 32768 THEN 'input_too_large' END AS fault, CASE WHEN strlen(j) <= 32768 THEN sha256(j) END AS input_sha256 FROM r")
def embedding_render(spark, d):
    return M.render(X.corpus(spark, d)).select("id", "version", "input_bytes", "fault", F.sha2("input", 256).alias("input_sha256"))


TERMS = ("the", "heat", "license")
_W = "regexp_extract_all(lower(title || ' ' || content || ' ' || lang), '[a-z0-9]+')"


@query(
    "bm25_plain_topk",
    f"WITH {X.CORPUS}, t AS (SELECT id, version, {_W} AS w FROM corpus), c AS (SELECT id, version, len(w) AS dl, " + ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS)) + " FROM t), n AS (SELECT count(*) AS n, avg(dl) AS avgdl, " + ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(3)) + " FROM c), s AS (SELECT id, version, " + " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(3)) + " AS score FROM c, n) SELECT CAST(row_number() OVER (ORDER BY score DESC, id, version) AS INTEGER) AS rank, id, version, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY 1 LIMIT 20",
)
def bm25_plain_topk(spark, d):
    return S.bm25(X.corpus(spark, d), " ".join(TERMS), 20).withColumn("score", F.round("score", 6))


def stems(vocabulary: str, word: str) -> str:
    """CTEs that end in st (word, stem): English stems of the distinct words of a relation, step by step."""
    q = lambda xs: ", ".join(f"'{x}'" for x in xs)
    v, o = "[aeiouy]", "[^aeiouy]"
    region, short = f"{o}*{v}+{o}", f"(?:^{v}{o}|{o}{v}[^aeiouywxY])$"
    ends = lambda xs: f"regexp_extract(w, '({'|'.join(xs)})$', 1)"
    base = "left(w, len(w) - len(s))"
    inside = lambda p: f"len(w) - len(s) >= {p}"
    become = lambda t: "CASE s " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in t.items()) + " END"
    start = rf"regexp_replace(regexp_replace(regexp_replace(word, '^''', ''), '^y', 'Y'), '({v})y', '\1Y', 'g')"
    steps = [
        (None, "regexp_replace(w, '(''s''|''s|'')$', '')"),
        (None, f"CASE WHEN w LIKE '%sses' THEN left(w, -2) WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, CASE WHEN len(w) > 4 THEN -2 ELSE -1 END) WHEN regexp_matches(w, '[us]s$') THEN w WHEN regexp_matches(w, '{v}.+s$') THEN left(w, -1) ELSE w END"),
        (ends(("eedly", "ingly", "edly", "eed", "ing", "ed")), f"""CASE WHEN s = '' OR w IN ({q(ST.INVARIANT_1A)}) THEN w WHEN s LIKE 'eed%' THEN CASE WHEN {inside("p1")} THEN {base} || 'ee' ELSE w END WHEN NOT regexp_matches({base}, '{v}') THEN w
   WHEN regexp_matches({base}, '(at|bl|iz)$') THEN {base} || 'e' WHEN regexp_matches({base}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left({base}, -1) WHEN len({base}) <= p1 AND regexp_matches({base}, '{short}') THEN {base} || 'e' ELSE {base} END"""),
        (None, rf"CASE WHEN fixed THEN w ELSE regexp_replace(w, '^(.+{o})[yY]$', '\1i') END"),
        (ends(ST.STEP_2), f"CASE WHEN fixed OR s = '' OR NOT {inside('p1')} OR s = 'ogi' AND {base} NOT LIKE '%l' OR s = 'li' AND NOT regexp_matches({base}, '[cdeghkmnrt]$') THEN w ELSE {base} || {become(ST.STEP_2)} END"),
        (ends(ST.STEP_3), f"CASE WHEN fixed OR s = '' OR NOT {inside('p1')} OR s = 'ative' AND NOT {inside('p2')} THEN w ELSE {base} || {become(ST.STEP_3)} END"),
        (ends(ST.STEP_4), f"CASE WHEN fixed OR s = '' OR NOT {inside('p2')} OR s = 'ion' AND NOT regexp_matches({base}, '[st]$') THEN w ELSE {base} END"),
        (ends("el"), f"CASE WHEN NOT fixed AND (s = 'e' AND ({inside('p2')} OR {inside('p1')} AND NOT regexp_matches({base}, '{short}')) OR s = 'l' AND {inside('p2')} AND {base} LIKE '%l') THEN {base} ELSE w END"),
    ]
    ctes = [
        f"s0 AS (SELECT DISTINCT {word} AS word, {start} AS w FROM {vocabulary})",
        f"s0a AS (SELECT *, coalesce(nullif(len(regexp_extract(w, '^({'|'.join(ST.HEADS)}|{region})', 1)), 0), len(w)) AS p1 FROM s0)",
        f"s0b AS (SELECT *, coalesce(p1 + nullif(len(regexp_extract(substr(w, p1 + 1), '^({region})', 1)), 0), len(w)) AS p2 FROM s0a)",
    ]
    for i, (suffix, change) in enumerate(steps, 1):
        # the third step sees which words the second one has left at a word that stays
        fixed = f"w IN ({q(ST.INVARIANT_1A)})" if i <= 3 else "fixed"
        ctes.append(f"s{i} AS (SELECT word, p1, p2, {fixed} AS fixed, {change} AS w FROM (SELECT *, {suffix or 'NULL'} AS s FROM {f's{i - 1}' if i > 1 else 's0b'}))")
    own = " ".join(f"WHEN word = '{k}' THEN '{x}'" for k, x in ST.IRREGULAR.items())
    ctes.append(f"st AS (SELECT word, CASE WHEN len(word) <= 2 OR word IN ({q(ST.INVARIANT)}) THEN word {own} ELSE translate(w, 'Y', 'y') END AS stem FROM s{len(steps)})")
    return ", ".join(ctes)


ENGLISH = "licenses and heating of the rain"


def english_bm25(query: str, corpus: str) -> str:
    """CTEs that end in best (rank, id, version, score): BM25 by stems over all rows of ``corpus``."""
    stop = ", ".join(f"'{x}'" for x in ST.STOP_WORDS)
    said = lambda c: rf"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN ({stop}))"
    whole = "title || ' ' || content || ' ' || lang"
    return f"""tok AS MATERIALIZED (SELECT id, version, unnest({said(whole)}) AS word FROM {corpus}),
 len AS MATERIALIZED (SELECT id, version, len({said(whole)}) AS dl FROM {corpus}),
 asked AS (SELECT unnest({said(f"'{query}'")}) AS word), both_words AS MATERIALIZED (SELECT word FROM tok UNION SELECT word FROM asked), {stems("both_words", "word")}, stm AS MATERIALIZED (SELECT * FROM st),
 trm AS (SELECT DISTINCT stem FROM asked JOIN stm USING (word)), tf AS MATERIALIZED (SELECT id, version, stem, count(*) AS tf FROM tok JOIN stm USING (word) JOIN trm USING (stem) GROUP BY ALL),
 df AS (SELECT stem, count(*) AS df FROM tf GROUP BY 1), num AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
 scr AS (SELECT id, version, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (stem) JOIN len USING (id, version), num GROUP BY 1, 2),
 best AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, id, version) AS INTEGER) AS rank, id, version, round(score, 6) AS score FROM scr)"""


@query("bm25_english_topk", f"WITH {X.CORPUS}, {english_bm25(ENGLISH, 'corpus')} SELECT * FROM best WHERE rank <= 20")
def bm25_english_topk(spark, d):
    return S.bm25(X.corpus(spark, d), ENGLISH, 20, english=True).withColumn("score", F.round("score", 6))


def revised(spark, d):
    """First versions of all documents, and second ones of two in five; some of these have no words."""
    c = X.corpus(spark, d)
    k = F.col("id").cast("long")
    content = F.when(k % 7 == 0, "...").otherwise(F.concat(F.lit("raining licensed heat "), F.substring("content", 41, 300)))
    return c, c.filter(k % 5 < 2).select("id", F.lit(2).cast("long").alias("version"), "type", F.lit("").alias("title"), content.alias("content"), "concepts")


REVISED = """rev AS (SELECT id, version, title, content, lang FROM corpus WHERE CAST(id AS BIGINT) % 5 >= 2 UNION ALL
 SELECT id, 2, '', CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN '...' ELSE 'raining licensed heat ' || substr(content, 41, 300) END, lang FROM corpus WHERE CAST(id AS BIGINT) % 5 < 2)"""


@query("bm25_index_topk", f"WITH {X.CORPUS}, {REVISED}, {english_bm25(ENGLISH, 'rev')} SELECT CAST(1 AS INTEGER) AS query_id, * FROM best WHERE rank <= 20")
def bm25_index_topk(spark, d):
    """An index kept by three batches (half of the first versions; the second versions, of which
    half come before their first ones; the other first versions), then a search by its postings."""
    first, second = revised(spark, d)
    k = F.col("id").cast("long")
    early, late = first.filter(k % 2 == 0), first.filter(k % 2 == 1)
    index = IX.TextIndex(fresh_path(spark, "text-index"))
    index.add(early.limit(0), early, 1)
    index.add(early, second, 2)
    index.add(early.unionByName(second), late, 3)
    asked = spark.createDataFrame([(1, ENGLISH)], "query_id int, query string")
    return index.bm25(asked, 20).withColumn("score", F.round("score", 6))


@query("english_stems", f"WITH voc AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), {stems('voc', 'word')} SELECT word, stem FROM st")
def english_stems(spark, d):
    voc = X.read(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word != ''").distinct()
    return ST.with_stems(voc)


@query(
    "hybrid_search_merge",
    ORACLE_SQL["bm25_plain_topk"].replace("SELECT CAST(row_number()", ", lex AS (SELECT CAST(row_number()", 1).replace(", n), s AS", ", n), s AS") + f"), {X.EMBEDDINGS}, v AS (SELECT a.id, a.version, {COSINE} AS score FROM emb a SEMI JOIN corpus c ON c.id = a.id, (SELECT embedding FROM emb WHERE id = '0') q), sem AS (SELECT id, version FROM v ORDER BY score DESC, id, version LIMIT 20), u AS (SELECT id, version, 0 AS src FROM lex UNION ALL SELECT id, version, 1 FROM sem), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, src) = 1) SELECT CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS rank, id, version, CASE src WHEN 0 THEN 'lexical' ELSE 'semantic' END AS origin FROM b ORDER BY id LIMIT 20",
)
def hybrid_search_merge(spark, d):
    c = X.corpus(spark, d)
    return S.merge(S.bm25(c, " ".join(TERMS), 20), S.vector(c, X.embeddings(spark, d), X.query_vector(spark, d), 20), 20)


@query("alias_normalize", "SELECT '  Ｃust. \u00a0Straße ﬁ ' || c_name || '\u2003ΣΑΣ' AS alias, 'cust. strasse fi ' || lower(c_name) || ' σασ' AS alias_key FROM customer")
def alias_normalize(spark, d):
    names = X.read(spark, d, "customer").select(F.concat(F.lit("  Ｃust. \u00a0Straße ﬁ "), F.col("c_name"), F.lit("\u2003ΣΑΣ")).alias("alias"))
    return names.select("alias", T.alias_key_column(F.col("alias")).alias("alias_key"))


@query("memory_faults", f"WITH {X.MEMORIES} SELECT id, version, CASE WHEN version % 3 = 0 THEN 'title:empty' WHEN version % 3 = 1 AND version > 1 THEN 'updated_at:order' END AS fault FROM memories")
def memory_faults(spark, d):
    m = X.memories(spark, d)
    day = F.lit(X.NOW).cast("timestamp")
    m = m.withColumns({"title": F.when(F.col("version") % 3 == 0, "").otherwise(F.col("title")), "created_at": day, "updated_at": F.when((F.col("version") % 3 == 1) & (F.col("version") > 1), day - F.expr("INTERVAL 1 SECOND")).otherwise(day)})
    # empty texts of the fixture are not the point here
    m = m.withColumn("content", F.lit("c")).withColumn("title", F.when(F.col("version") % 3 == 0, "").otherwise("t"))
    return m.select("id", "version", M.version_fault().alias("fault"))


@query("embedding_faults", "SELECT vec_id, CASE WHEN vec_id % 4 = 1 THEN 'zero_norm' WHEN vec_id % 4 = 2 THEN 'dimensions' END AS fault FROM embeddings")
def embedding_faults(spark, d):
    e = X.read(spark, d, "embeddings")
    v = F.when(F.col("vec_id") % 4 == 1, F.array(F.lit(0.0), F.lit(0.0)).cast("array<double>")).when(F.col("vec_id") % 4 == 2, F.array().cast("array<double>")).otherwise(F.col("embedding").cast("array<double>"))
    return e.select("vec_id", M.vector_fault(v).alias("fault"))


@query(
    "embedding_coordinate",
    f"WITH {X.CORPUS}, {X.EMBEDDINGS}, k AS (SELECT CAST(c.id AS BIGINT) AS ordinal, CASE WHEN CAST(c.id AS BIGINT) % 50 = 49 THEN 'missing' WHEN e.id IS NOT NULL THEN 'already_present' ELSE 'stored' END AS state, CASE WHEN strlen(to_json({{'format': 'v1', 'title': title, 'content': content, 'concepts': [lang]}})) > 2000 THEN 'input_too_large' END AS fault FROM corpus c LEFT JOIN emb e USING (id)) SELECT count(*) AS selected, count(*) FILTER (state = 'stored') AS stored, count(*) FILTER (state = 'already_present') AS already_present, count(*) FILTER (state = 'missing') AS missing, min(ordinal) FILTER (fault IS NOT NULL) || ':' || min_by(fault, ordinal) FILTER (fault IS NOT NULL) AS first_fault FROM k",
)
def embedding_coordinate(spark, d):
    c = X.corpus(spark, d)
    k = F.col("id").cast("long")
    held = X.embeddings(spark, d).select("id").withColumn("held", F.lit(True))
    state = F.when(k % 50 == 49, "missing").when(F.col("held"), "already_present").otherwise("stored")
    rows = M.render(c, 2000).join(held, "id", "left").select(k.alias("ordinal"), state.alias("state"), F.concat_ws(":", F.when(F.col("fault").isNotNull(), k.cast("string")), "fault").alias("f"))
    rows = rows.select("ordinal", "state", F.when(F.col("f") != "", F.col("f")).alias("fault"))
    return M.coordinate(rows)


@query("search_without_embedder", f"WITH {X.CORPUS}, {X.EMBEDDINGS} " + "SELECT CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS rank, id, version, 'lexical' AS origin FROM (" + ORACLE_SQL["bm25_plain_topk"] + ")")
def search_without_embedder(spark, d):
    """An embedder that is out of reach, or answers with another number of vectors, leaves the
    lexical result."""
    c = X.corpus(spark, d)

    def gone(texts):
        raise ConnectionError("out of reach")

    return S.search(c, X.embeddings(spark, d), " ".join(TERMS), 20, gone, english=False)


@query("concept_lists", "SELECT c_custkey AS ordinal, CASE c_custkey % 4 WHEN 0 THEN 'Alpha,beta' WHEN 3 THEN '' END AS concepts FROM customer")
def concept_lists(spark, d):
    k = F.col("c_custkey")
    lists = F.when(k % 4 == 0, F.array(F.lit("\u00a0Alpha "), F.lit("beta\t"))).when(k % 4 == 1, F.array(F.lit("a"), F.lit(" \u2003"))).when(k % 4 == 2, F.array(F.lit("Alpha"), F.lit(" aLPHA"))).otherwise(F.array().cast("array<string>"))
    return X.read(spark, d, "customer").select(k.alias("ordinal"), F.array_join(P.normal_concepts(lists), ",").alias("concepts"))


_RESPONSES = ("", "remote_error", "provider_mismatch", "remote_error", "model_mismatch", "count_mismatch", "invalid_vector", "invalid_vector", "invalid_vector", "remote_error")


@query(
    "embedding_responses",
    "SELECT vec_id AS request, CASE vec_id % 10 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_RESPONSES) if f) + " END AS fault, CASE WHEN vec_id % 10 = 0 THEN CAST(2 AS INTEGER) END AS n_vectors, CASE WHEN vec_id % 10 = 0 THEN CAST(CAST(embedding[1] AS FLOAT) AS DOUBLE) END AS first_component FROM embeddings",
)
def embedding_responses(spark, d):
    """Responses of an embedder for two inputs each: one that is right and nine that are not."""
    e = X.read(spark, d, "embeddings")
    k = F.col("vec_id") % 10
    v = F.col("embedding").cast("array<double>")
    vectors = F.when(k == 5, F.array(v)).when(k == 7, F.array(v, F.array(F.lit(1.0), F.lit(1e39)))).when(k == 8, F.array(v, F.array(F.lit(0.0), F.lit(0.0)))).otherwise(F.array(v, v))
    body = F.to_json(F.struct(F.when(k == 2, "q").otherwise("p").alias("provider"), F.when(k == 4, "other").otherwise("m").alias("model"), vectors.alias("embeddings")))
    body = F.when(k == 1, F.regexp_replace(body, r"}$", ',"usage":{}}')).when(k == 3, F.replace(body, F.lit('"model":"m"'), F.lit('"model":7'))).when(k == 6, F.regexp_replace(body, r"\]\]}$", ',"1"]]}')).when(k == 9, F.regexp_replace(body, r'"embeddings":.*$', '"embeddings":null}')).otherwise(body)
    out = M.decode_embeddings(e.select(F.col("vec_id").alias("request"), F.lit(2).alias("n_inputs"), body.alias("json")), "p", "m")
    return out.select("request", "fault", F.when(F.col("fault").isNull(), F.size("vectors")).alias("n_vectors"), F.col("vectors")[0][0].cast("double").alias("first_component"))


def _lengths(texts):
    return [[float(len(x.encode())), 1.0] for x in texts]


@query("embedding_calls", f"WITH {X.CORPUS} SELECT id, version, CAST(2 AS INTEGER) AS n_components, CAST(strlen(to_json({{'format': 'v1', 'title': title, 'content': content, 'concepts': [lang]}})) AS DOUBLE) AS first_component FROM corpus")
def embedding_calls(spark, d):
    """An embedder that measures its input is called for every rendered version, in batches."""
    made = M.embed(M.render(X.corpus(spark, d), 1 << 24), _lengths, 16)
    return made.select("id", "version", F.size("embedding").alias("n_components"), F.col("embedding")[0].cast("double").alias("first_component"))


@query(
    "memory_gated_reads",
    f"""WITH {X.MEMORIES}, m AS (SELECT id, version, CASE WHEN version % 5 = 0 THEN 'title:empty' WHEN version % 3 = 0 AND CAST(id AS BIGINT) % 4 = 0 THEN 'content:nul' END AS f FROM memories)
 SELECT id, count(*) AS n_rows, arg_max(f, version) FILTER (f IS NOT NULL) AS fault, CASE WHEN count(f) = 0 THEN string_agg(CAST(version AS VARCHAR), ',' ORDER BY version DESC) END AS versions FROM m GROUP BY 1""",
)
def memory_gated_reads(spark, d):
    """A read fails as a whole, with the fault of its first faulty row."""
    v, day = F.col("version"), F.lit(X.NOW).cast("timestamp")
    content = F.when((v % 3 == 0) & (F.col("id").cast("long") % 4 == 0), "a\0b").otherwise("c")
    m = X.memories(spark, d).withColumns({"title": F.when(v % 5 == 0, "").otherwise("t"), "content": content, "created_at": day, "updated_at": day})
    return M.read_versions(m).withColumn("versions", F.array_join(F.transform("versions", lambda x: x.cast("string")), ","))


@query(
    "memory_get_outcomes",
    f"""WITH {X.MEMORIES}, r AS (SELECT c_custkey AS ordinal, CASE c_custkey % 6 WHEN 5 THEN '' ELSE CAST(c_custkey % 120 AS VARCHAR) END AS id, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 2 WHEN 2 THEN 99 WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE 1 END AS asked FROM customer),
 w AS (SELECT *, coalesce(asked, (SELECT max(version) FROM memories m WHERE m.id = r.id)) AS wanted FROM r),
 j AS (SELECT ordinal, CASE WHEN w.id = '' OR asked < 1 THEN 'invalid_request' WHEN m.id IS NULL THEN 'not_found' WHEN m.version % 4 = 0 THEN 'invalid_response' ELSE 'found' END AS outcome, m.version, m.title FROM w LEFT JOIN memories m ON m.id = w.id AND m.version = wanted)
 SELECT ordinal, outcome, CASE WHEN outcome = 'found' THEN version END AS version, CASE WHEN outcome = 'found' THEN title END AS title FROM j""",
)
def memory_get_outcomes(spark, d):
    """Reads of single memories, exact and latest, with what they answer when there is none."""
    k = F.col("c_custkey")
    r = X.read(spark, d, "customer").select(k.alias("ordinal"), F.when(k % 6 == 5, "").otherwise((k % 120).cast("string")).alias("id"), F.when(k % 6 == 1, 2).when(k % 6 == 2, 99).when(k % 6 == 3, 0).when(k % 6 == 5, 1).cast("long").alias("version"))
    day = F.lit(X.NOW).cast("timestamp")
    m = X.memories(spark, d).withColumns({"created_at": day, "updated_at": F.when(F.col("version") % 4 == 0, day - F.expr("INTERVAL 1 SECOND")).otherwise(day)})
    return M.get_outcomes(m, r).select("ordinal", "outcome", "version", "title")
