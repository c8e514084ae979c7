"""Versioned memories: heads, look-ups, pages, insert outcomes, embedding maintenance.

Tables are append-only.  A head is derived, never stored: ``max_by`` over versions is a
partial aggregate, so versions that come out of order never move a head back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import limits


def heads(memories: DataFrame) -> DataFrame:
    """The row with the greatest version of every id."""
    rest = [c for c in memories.columns if c not in ("id", "version")]
    top = memories.groupBy("id").agg(F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("r"))
    return top.select("id", "version", "r.*").select(*memories.columns)


def get_exact(memories: DataFrame, id: str, version: int) -> DataFrame:
    return memories.filter((F.col("id") == id) & (F.col("version") == limits.bounded("version", version, 1, 2**63 - 1)))


def get_latest(memories: DataFrame, id: str) -> DataFrame:
    return heads(memories.filter(F.col("id") == id))


def get_outcomes(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ordinal, id, version; null asks for the latest) -> ordinal, outcome, version, title,
    content: found, not_found, invalid_request (empty id, NUL, version below 1) or invalid_response
    (the stored row is at fault).  Two joins for any number of requests."""
    nul = F.instr(F.col("id"), "\0") > 0
    invalid = F.coalesce((F.col("id") == "") | nul, F.lit(True)) | F.coalesce(F.col("version") < 1, F.lit(False))
    r = requests.select("ordinal", "id", F.col("version").alias("asked"), invalid.alias("invalid"))
    top = memories.join(r.filter("asked is null and not invalid").select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max("version").alias("top"))
    stored = memories.select("id", F.col("version").alias("wanted"), "title", "content", version_fault().alias("fault"), F.lit(True).alias("there"))
    j = r.join(top, "id", "left").withColumn("wanted", F.when(~F.col("invalid"), F.coalesce("asked", "top"))).join(stored, ["id", "wanted"], "left")
    outcome = F.when(F.col("invalid"), "invalid_request").when(F.col("there").isNull(), "not_found").when(F.col("fault").isNotNull(), "invalid_response").otherwise("found")
    shown = lambda c, name: F.when(outcome == "found", F.col(c)).alias(name)
    return j.select("ordinal", outcome.alias("outcome"), shown("wanted", "version"), shown("title", "title"), shown("content", "content"))


def list_versions(memories: DataFrame, id: str, offset: int = 0, limit: int = limits.VERSION_PAGE) -> DataFrame:
    """A page of versions, newest first, with ``position`` and ``next_offset`` (null on the last page)."""
    limits.bounded("offset", offset, 0, limits.VERSION_OFFSET_MAX)
    limits.bounded("limit", limit, 1, limits.VERSION_PAGE_MAX)
    page = memories.filter(F.col("id") == id).orderBy(F.col("version").desc()).offset(offset).limit(limit + 1)
    page = page.withColumn("position", F.row_number().over(Window.orderBy(F.col("version").desc())))
    more = F.max("position").over(Window.partitionBy()) > limit
    return page.withColumn("next_offset", F.when(more, F.lit(offset + limit).cast("long"))).filter(F.col("position") <= limit)


def insert_outcomes(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ordinal, id, version, ...) -> + outcome inserted / conflict.

    A key that is stored, or that an earlier request of the batch has taken, is a conflict."""
    key = ["id", "version"]
    stored = memories.select(*key).distinct().withColumn("stored", F.lit(True))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("ordinal")) == 1
    return requests.join(stored, key, "left").withColumn("outcome", F.when(F.col("stored").isNull() & first, "inserted").otherwise("conflict")).drop("stored")


def append(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """The table after :func:`insert_outcomes`."""
    new = insert_outcomes(memories, requests).filter("outcome = 'inserted'")
    return memories.unionByName(new.select(*memories.columns))


def vector_fault(v):
    """First fault of an embedding, null if it is valid."""
    from ..functions.text import first_failure

    return first_failure(
        (v.isNull() | (F.size(v) < 1) | (F.size(v) > limits.VECTOR_COMPONENTS), "dimensions"),
        (F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite"),
        (F.exists(v, lambda x: x.cast("float").cast("double") != x.cast("double")), "not_single_precision"),
        (~F.exists(v, lambda x: x != 0), "zero_norm"),
    )


def embedding_outcomes(memories: DataFrame, embeddings: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ordinal, id, version) -> + outcome inserted / conflict / missing (no parent)."""
    key = ["id", "version"]
    parent = memories.select(*key).distinct().withColumn("parent", F.lit(True))
    stored = embeddings.select(*key).distinct().withColumn("stored", F.lit(True))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("ordinal")) == 1
    out = F.when(F.col("parent").isNull(), "missing").when(F.col("stored").isNull() & first, "inserted").otherwise("conflict")
    return requests.join(parent, key, "left").join(stored, key, "left").withColumn("outcome", out).drop("parent", "stored")


def load_keys(memories: DataFrame, embeddings: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (ordinal, id, version) -> state pending / already_present / missing; the document
    columns are filled for pending keys only."""
    key = ["id", "version"]
    m = memories.select(*key, "title", "content", "concepts").withColumn("m", F.lit(True))
    e = embeddings.select(*key).distinct().withColumn("e", F.lit(True))
    state = F.when(F.col("m").isNull(), "missing").when(F.col("e").isNotNull(), "already_present").otherwise("pending")
    out = keys.join(m, key, "left").join(e, key, "left").withColumn("state", state)
    return out.select("ordinal", *key, "state", *[F.when(F.col("state") == "pending", F.col(c)).alias(c) for c in ("title", "content", "concepts")])


def list_missing(memories: DataFrame, embeddings: DataFrame, limit: int) -> DataFrame:
    """Versions (all, not heads only) without an embedding, by id and version."""
    rest = memories.select("id", "version").join(embeddings.select("id", "version"), ["id", "version"], "left_anti")
    return rest.orderBy("id", "version").limit(limit)


def render(memories: DataFrame, max_bytes: int = limits.EMBED_INPUT_BYTES, format: str = "v1") -> DataFrame:
    """id, version, input (compact JSON), input_bytes, fault (input_too_large)."""
    doc = F.to_json(F.struct(F.lit(format).alias("format"), "title", "content", "concepts"))
    out = memories.select("id", "version", doc.alias("input")).withColumn("input_bytes", F.octet_length("input"))
    too_large = F.col("input_bytes") > max_bytes
    return out.withColumn("fault", F.when(too_large, "input_too_large")).withColumn("input", F.when(~too_large, F.col("input")))


def embed(rendered: DataFrame, embedder, batch: int = limits.EMBED_BATCH) -> DataFrame:
    """Calls ``embedder(list[str]) -> list[list[float]]`` per batch; positional, count checked."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                vectors = embedder(part["input"].tolist())
                if len(vectors) != len(part):
                    raise ValueError("the embedder returned another number of vectors")
                yield pd.DataFrame({"id": part["id"].values, "version": part["version"].values, "embedding": vectors})

    return rendered.filter("fault is null").select("id", "version", "input").mapInPandas(run, "id string, version long, embedding array<float>")


def decode_embeddings(responses: DataFrame, provider: str, model: str) -> DataFrame:
    """responses (request, n_inputs, json) -> request, fault, vectors (an array of float arrays, one
    an input in order; null with a fault).

    A response is an object of provider, model and embeddings and nothing else; it has to echo
    the provider and the model that were asked, and to hold a vector for each input.  Components are
    narrowed to single precision and must be finite then; a vector at fault fails the response."""
    from ..functions.text import first_failure

    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit(""))
    get = lambda k: F.try_variant_get("parsed", f"$.{k}", "variant")
    said = lambda k: F.when(kind(get(k)) == "STRING", F.try_variant_get("parsed", f"$.{k}", "string"))
    number = lambda x: kind(x).isin("BIGINT", "DOUBLE", "FLOAT") | kind(x).startswith("DECIMAL")
    # a vector becomes null if it is no array of numbers
    single = lambda x: F.when(number(x), F.try_variant_get(x, "$", "double").cast("float"))
    vector = lambda v: F.when(kind(v).startswith("ARRAY"), F.transform(F.try_variant_get(v, "$", "array<variant>"), single))
    df = responses.withColumn("parsed", F.try_parse_json("json"))
    df = df.select("request", "n_inputs", F.array_sort(F.json_object_keys("json")).alias("keys"), said("provider").alias("provider"), said("model").alias("model"), F.when(kind(get("embeddings")).startswith("ARRAY"), F.transform(F.try_variant_get("parsed", "$.embeddings", "array<variant>"), vector)).alias("vectors"))
    bad = lambda v: v.isNull() | (F.size(v) < 1) | (F.size(v) > limits.VECTOR_COMPONENTS) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    exact = F.coalesce(F.col("keys") == F.array(F.lit("embeddings"), F.lit("model"), F.lit("provider")), F.lit(False))
    fault = first_failure(
        (~exact | F.col("provider").isNull(), "remote_error"),
        (F.col("provider") != provider, "provider_mismatch"),
        (F.col("model").isNull(), "remote_error"),
        (F.col("model") != model, "model_mismatch"),
        (F.col("vectors").isNull(), "remote_error"),
        (F.size("vectors") != F.col("n_inputs"), "count_mismatch"),
        (F.exists("vectors", bad), "invalid_vector"),
    )
    return df.select("request", fault.alias("fault"), F.when(fault.isNull(), F.col("vectors")).alias("vectors"))


def coordinate(rows: DataFrame) -> DataFrame:
    """One row: counts of states and the fault of the lowest ordinal (ordinal, state, fault)."""
    n = lambda s: F.count_if(F.col("state") == s)
    return rows.agg(F.count(F.lit(1)).alias("selected"), n("stored").alias("stored"), n("already_present").alias("already_present"), n("missing").alias("missing"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("ordinal"))).alias("first_fault"))


def save(title: str, content: str, session_id: str, now, spark, new_id: str) -> DataFrame:
    """The row that saving a note adds: version 1, type unclassified, no lists but the session."""
    schema = "id string, version long, type string, title string, content string, created_at timestamp, updated_at timestamp, concepts array<string>, files array<string>, session_ids array<string>, source_observation_ids array<string>"
    return spark.createDataFrame([(new_id, 1, "unclassified", title, content, now, now, [], [], [session_id], [])], schema)


def version_fault():
    """First fault of a memory row (columns as in :func:`save`), null if valid."""
    from ..functions.text import first_failure

    text = lambda c: (F.col(c).isNull() | (F.col(c) == ""), f"{c}:empty")
    nul = lambda c: (F.instr(F.col(c), "\0") > 0, f"{c}:nul")
    checks = [text("id"), nul("id"), (F.col("version") < 1, "version:not_positive")]
    for c in ("type", "title", "content"):
        checks += [text(c), nul(c)]
    checks += [(~F.year("created_at").between(1, 9999), "created_at:range"), (F.col("updated_at") < F.col("created_at"), "updated_at:order")]
    return first_failure(*checks)


def rendered_time(c):
    """A timestamp in UTC with microseconds and its offset, as responses show it."""
    return F.concat(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


#: What a writer reports for an outcome of the store, and whether that is a failure.
WRITES = (("inserted", "stored", False), ("conflict", "already_present", False), ("missing", "missing_parent", True), ("invalid", "malformed_response", True), ("invalid_response", "malformed_response", True), ("database_failure", "backend", True))


def write_outcomes(rows: DataFrame) -> DataFrame:
    """outcome of the store -> outcome and failed of the writer; anything unknown is malformed."""
    t = rows.sparkSession.createDataFrame(list(WRITES), "outcome string, mapped string, failed boolean")
    return rows.join(F.broadcast(t), "outcome", "left").withColumns({"outcome": F.coalesce("mapped", F.lit("malformed_response")), "failed": F.coalesce("failed", F.lit(True))}).drop("mapped")


def event_outcomes(rows: DataFrame) -> DataFrame:
    """event, ordinal, state, fault -> a row per event: its counts and its error.

    All of an event's work is done before a missing key makes it fail; the first fault of the
    work itself comes before that."""
    n = lambda s: F.count_if(F.col("state") == s)
    fault = F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("ordinal")))
    per = rows.groupBy("event").agg(F.count(F.lit(1)).alias("selected"), n("stored").alias("stored"), n("already_present").alias("already_present"), n("missing").alias("missing"), fault.alias("fault"))
    return per.select("event", "selected", "stored", "already_present", F.coalesce("fault", F.when(F.col("missing") > 0, "missing")).alias("error"))


def decode_gate(rows: DataFrame) -> DataFrame:
    """One row: the number of rows and the fault that makes the whole result fail, null if all
    rows are valid (columns as in :func:`save`).  Rows are decoded by id, newest version first:
    the first faulty one decides."""
    order = F.struct(F.col("id"), -F.col("version"))
    return rows.select("id", "version", version_fault().alias("fault")).agg(F.count(F.lit(1)).alias("n"), F.min_by("fault", F.when(F.col("fault").isNotNull(), order)).alias("fault"))


def read_versions(memories: DataFrame) -> DataFrame:
    """id, n_rows, fault, versions: the versions of every id, newest first, as one read each, which
    its first faulty row makes fail: then it has no versions."""
    each = memories.select("id", "version", version_fault().alias("fault"))
    first = F.max_by("fault", F.when(F.col("fault").isNotNull(), F.col("version")))
    out = each.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"), first.alias("fault"), F.sort_array(F.collect_list("version"), asc=False).alias("versions"))
    return out.withColumn("versions", F.when(F.col("fault").isNull(), F.col("versions")))
