"""Bounds that callers can observe."""

SEARCH_LIMIT = 50
VERSION_PAGE, VERSION_PAGE_MAX, VERSION_OFFSET_MAX = 50, 100, 9007199254740891
VECTOR_COMPONENTS = 16000
ALIASES_PER_CONCEPT, ALIAS_DISPLAY_BYTES, ALIAS_KEY_BYTES, SOURCE_KEY_BYTES = 64, 512, 2048, 2048
EVIDENCE_PER_ASSERTION = 32
NEIGHBORS, RELATED_SOURCES, PATHS = 256, 256, 50
PATH_DEPTH, PATH_WORK = 8, 10_000
RESPONSE_BYTES = 4 * 1024 * 1024
EMBED_INPUT_BYTES, EMBED_BATCH = 32768, 16
SWEEP_BATCH, LEASE_SECONDS, CHUNK_BYTES = 10, 600, 131072
SUMMARY_SENTENCES, FINAL_CONCEPTS = 5, 10
ELIGIBLE_HOURS = 24


def bounded(name: str, value: int, low: int, high: int) -> int:
    if not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value
