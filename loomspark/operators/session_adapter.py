"""The third adapter: which native events count, what of them stays, and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Native events that are observations whatever they hold.
OBSERVATIONS = ("session_info_changed", "session_compact", "session_compact_failed", "agent_start", "agent_settled", "ui_prompt_start", "ui_prompt_end", "turn_start", "turn_end", "tool_execution_start", "tool_execution_end")
#: Fixed values of its envelope.
SOURCE, VERSION = "pi", "1.0.0"


def classify(events: DataFrame) -> DataFrame:
    """type, role -> + selection: start, end, observation or excluded; a finished message counts
    only if a user or the assistant wrote it."""
    t = F.col("type")
    spoken = (t == "message_end") & F.col("role").isin("user", "assistant")
    return events.withColumn("selection", F.when(t == "session_start", "start").when(t == "session_shutdown", "end").when(t.isin(*OBSERVATIONS) | F.coalesce(spoken, F.lit(False)), "observation").otherwise("excluded"))


def text_content(content, blocks, omitted: tuple[str, ...]):
    """The text of a message: a string as it is, else its text blocks joined; blocks of ``omitted``
    types are left out, and any other block, or a text block without text, gives null."""
    ok = F.forall(blocks, lambda b: F.when(b["type"] == "text", b["text"].isNotNull()).otherwise(F.coalesce(b["type"].isin(*omitted), F.lit(False))))
    text = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")
    return F.coalesce(content, F.when(ok, text))


def admission(submissions: DataFrame, capacity: int) -> DataFrame:
    """session_id, seq, kind (start, observation, end) -> + admitted, for a queue that nothing
    leaves meanwhile: an observation beyond ``capacity`` overflows and is the one that goes; a
    first observation starts the session; lifecycle events are never dropped; nothing follows an
    end, and a second start is ignored.  '' is not admitted."""
    past = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda kind: F.coalesce(F.count_if(F.col("kind") == kind).over(past), F.lit(0))
    n, ended = seen("observation"), seen("end") > 0
    started = (seen("start") + n) > 0
    out = F.when(ended, "").when(F.col("kind") == "end", "end").when(F.col("kind") == "start", F.when(started, "").otherwise("start")).when(n >= capacity, "overflow").when(~started, "start,observation").otherwise("observation")
    return submissions.withColumn("admitted", out)


# --- projection by rules -------------------------------------------------------------------

#: The words that some fields are limited to.
REASONS = ("manual", "threshold", "overflow")
PROMPTS = ("select", "confirm", "input", "editor", "custom")
STOPS = ("pending", "stop", "length", "toolUse", "error", "aborted", "deferred")
#: What each kind's payload keeps: (field, type, required).  A type is a variant's, a
#: tuple of words, "any", or the name of another rule for an object.
RULES = {
    "session_info_changed": (("name", "string", False),),
    "session_compact": (("compactionEntry", "compactionEntry", True), ("fromExtension", "boolean", True), ("reason", REASONS, True), ("willRetry", "boolean", True)),
    "session_compact_failed": (("aborted", "boolean", True), ("fromExtension", "boolean", True), ("reason", REASONS, True), ("willRetry", "boolean", True), ("errorMessage", "string", False)),
    "agent_start": (),
    "agent_settled": (),
    "ui_prompt_start": (("kind", PROMPTS, True), ("reason", ("ui_prompt",), True), ("title", "string", False)),
    "ui_prompt_end": (("kind", PROMPTS, True), ("reason", ("ui_prompt",), True), ("title", "string", False)),
    "turn_start": (("timestamp", "number", True), ("turnIndex", "number", True)),
    "turn_end": (("turnIndex", "number", True),),
    "tool_execution_start": (("args", "any", True), ("toolCallId", "string", True), ("toolName", "string", True)),
    "tool_execution_end": (("isError", "boolean", True), ("result", "any", True), ("toolCallId", "string", True), ("toolName", "string", True)),
    "compactionEntry": (("firstKeptEntryId", "string", True), ("id", "string", True), ("parentId", "string?", True), ("timestamp", "string", True), ("tokensBefore", "number", True), ("fromHook", "boolean", False)),
    "user": (("timestamp", "number", True),),
    "assistant": (("api", "string", True), ("model", "string", True), ("provider", "string", True), ("stopReason", STOPS, True), ("timestamp", "number", True), ("usage", "usage", True), ("responseModel", "string", False), ("errorMessage", "string", False)),
    "usage": (("cacheRead", "number", True), ("cacheWrite", "number", True), ("cost", "cost", True), ("input", "number", True), ("output", "number", True), ("totalTokens", "number", True), ("cacheWrite1h", "number", False), ("reasoning", "number", False)),
    "cost": (("cacheRead", "number", True), ("cacheWrite", "number", True), ("input", "number", True), ("output", "number", True), ("total", "number", True)),
}


def _kind(x):
    return F.coalesce(F.schema_of_variant(x), F.lit(""))


def _is(x, wanted):
    """Whether a variant has the type; numbers are finite, as JSON's are."""
    k = _kind(x)
    if isinstance(wanted, tuple):
        return (k == "STRING") & F.coalesce(F.try_variant_get(x, "$", "string").isin(*wanted), F.lit(False))
    return {
        "string": k == "STRING",
        "string?": k.isin("STRING", "VOID"),
        "boolean": k == "BOOLEAN",
        "number": (k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")) & (F.abs(F.try_variant_get(x, "$", "double")) < float("inf")),
        "any": x.isNotNull(),
    }[wanted]


def _quoted(text):
    """A string as JSON."""
    whole = F.to_json(F.struct(text.alias("t")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _text(content, omitted: tuple[str, ...]):
    """The text of a message's content as a variant: a string, or blocks as in ``text_content``."""
    get = lambda b, k: F.try_variant_get(b, f"$.{k}", "variant")
    word = lambda b, k: F.when(_kind(get(b, k)) == "STRING", F.try_variant_get(b, f"$.{k}", "string"))
    blocks = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda b: F.struct(word(b, "type").alias("type"), word(b, "text").alias("text")))
    return text_content(F.when(_kind(content) == "STRING", F.try_variant_get(content, "$", "string")), F.when(_kind(content).startswith("ARRAY"), blocks), omitted)


def _object(v, fields: tuple[tuple, ...], more: tuple = ()):
    """(valid, JSON) of the object that keeps ``fields`` of the variant ``v`` and the (name, JSON) of ``more``."""
    ok, parts = _kind(v).startswith("OBJECT"), [(name, text) for name, text in more]
    for name, wanted, required in fields:
        x = F.try_variant_get(v, f"$.{name}", "variant")
        if isinstance(wanted, str) and wanted in RULES:
            good, text = _object(x, RULES[wanted])
        else:
            good, text = _is(x, wanted), F.to_json(x)
        ok = ok & (good if required else (x.isNull() | good))
        parts.append((name, F.when(x.isNotNull(), text)))
    for _, text in more:
        ok = ok & text.isNotNull()
    parts = [F.concat(F.lit(f'"{name}":'), text) for name, text in sorted(parts, key=lambda p: p[0])]
    return F.coalesce(ok, F.lit(False)), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def project(events: DataFrame) -> DataFrame:
    """type, native (JSON text) -> + envelope (JSON with sorted keys, null if none) and fault:
    ``excluded`` (not an observation), ``normalization`` (a field is missing or of another type).

    Text is parsed once to a variant; only what a rule names is kept."""
    df = events.withColumn("__v", F.try_parse_json("native")).withColumn("__m", F.try_variant_get("__v", "$.message", "variant"))
    v, message = F.col("__v"), F.col("__m")
    role = F.when(_kind(F.try_variant_get(message, "$.role", "variant")) == "STRING", F.try_variant_get(message, "$.role", "string"))
    content = F.try_variant_get(message, "$.content", "variant")
    user = _object(message, RULES["user"], (("role", F.lit('"user"')), ("text", _quoted_or_null(_text(content, ("image",))))))
    spoken = F.when(_kind(content).startswith("ARRAY"), _text(content, ("thinking", "toolCall")))
    assistant = _object(message, RULES["assistant"], (("role", F.lit('"assistant"')), ("text", _quoted_or_null(spoken))))
    ok, text = F.lit(False), F.lit(None).cast("string")
    for kind in OBSERVATIONS:
        good, made = _object(v, RULES[kind])
        ok, text = F.when(F.col("type") == kind, good).otherwise(ok), F.when(F.col("type") == kind, made).otherwise(text)
    is_message = F.col("type") == "message_end"
    ok = F.when(is_message & (role == "user"), user[0]).when(is_message & (role == "assistant"), assistant[0]).otherwise(ok)
    text = F.when(is_message & (role == "user"), user[1]).when(is_message & (role == "assistant"), assistant[1]).otherwise(text)
    foreign = ~F.coalesce(F.col("type").isin(*OBSERVATIONS, "message_end"), F.lit(False)) | F.coalesce(is_message & _kind(message).startswith("OBJECT") & ~role.isin("user", "assistant"), F.lit(False))
    fault = F.when(foreign, "excluded").when(~ok, "normalization")
    envelope_ = F.concat(F.lit('{"event":'), _quoted(F.col("type")), F.lit(',"payload":'), text, F.lit(f',"source":"{SOURCE}","version":"{VERSION}"}}'))
    return df.withColumn("fault", fault).withColumn("envelope", F.when(F.col("fault").isNull(), envelope_)).drop("__v", "__m")


def _quoted_or_null(text):
    return F.when(text.isNotNull(), _quoted(text))
