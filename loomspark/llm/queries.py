"""The operators' registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, conversations, licenses, linededup, mixing, neardup, quality, secrets, suffixes, tokencount, toxicity, tries

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_neardup": neardup.op2_neardup,
    "op3_tokencounts": tokencount.op3_tokencounts,
    "op4_ann": ann.op4_ann,
    "op5_quality": quality.op5_quality,
    "op6_linededup": linededup.op6_linededup,
    "op7_bpe": bpe.op7_bpe,
    "op8_licenses": licenses.op8_licenses,
    "op9_secrets": secrets.op9_secrets,
    "op10_mixing": mixing.op10_mixing,
    "op11_conversations": conversations.op11_conversations,
    "op12_prefixtrie": tries.op12_prefixtrie,
    "op13_repeats": suffixes.op13_repeats,
}

#: All pairs that share a shingle, which the small tables allow.
NEARDUP = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS set FROM d),
 e AS MATERIALIZED (SELECT doc_id, hash(unnest(set)) AS h FROM s),
 n AS MATERIALIZED (SELECT doc_id, CAST(len(set) AS BIGINT) AS n FROM s),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
 g AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r AS (SELECT doc_id, doc_id AS node FROM n UNION SELECT r.doc_id, g.y FROM r JOIN g ON g.x = r.node),
 c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY 1)
 SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c USING (doc_id)"""


def _licenses() -> str:
    """The licence scan, with texts compared by their canonical forms themselves."""
    q = lambda t: "'" + t.replace("'", "''") + "'"
    spelled = f"regexp_replace(lower(coalesce(text, '')), {q(licenses.COPYRIGHT_LINE)}, ' ', 'g')"
    for variant, spelling in licenses.SPELLINGS:
        spelled = f"replace({spelled}, {q(variant)}, {q(spelling)})"
    spelled = rf"regexp_replace({spelled}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    flat = lambda c: rf"trim(regexp_replace({c}, '[\x20\n]+', ' ', 'g'))"
    titles = "|".join(sorted(licenses.TITLES, key=len, reverse=True))
    untitled = lambda c: rf"regexp_replace({c}, '^(?:[\x20\n]*(?:(?:{titles})\x20?(?:\n|$)))+', '')"
    known = ", ".join(f"({q(i)}, {q(t)})" for i, t in licenses.LICENSES)
    runs = " || ".join(f"list_transform(range(0, len(p) - {k - 1}), lambda i: array_to_string(list_transform(p[i + 1:i + {k}], lambda x: x.c), ' '))" if k > 1 else "list_transform(list_filter(p, lambda x: x.l), lambda x: x.c)" for k in sorted({t.count("\n\n") + 1 for _, t in licenses.LICENSES}))
    return rf"""WITH k AS MATERIALIZED (SELECT min(id) AS license_id, whole FROM (SELECT id, {flat(untitled("c"))} AS whole FROM (SELECT id, {spelled} AS c FROM (VALUES {known}) t(id, text))) GROUP BY 2),
 c AS MATERIALIZED (SELECT doc_id, {spelled} AS c FROM documents),
 p AS (SELECT doc_id, {flat(untitled("c"))} AS whole, list_transform(string_split(c, chr(10)), lambda x: trim(x)) AS lines,
  list_filter(list_transform(string_split_regex(c, '\n\x20?(?:\n\x20?)+'), lambda x: {{'l': contains(trim(x, ' ' || chr(10)), chr(10)), 'c': {flat("x")}}}), lambda x: x.c != '') AS p FROM c),
 x AS (SELECT doc_id, unnest(lines || {runs}) AS piece FROM p),
 f AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS ids FROM x JOIN k ON piece = k.whole AND piece != '' GROUP BY 1)
 SELECT p.doc_id, CASE WHEN p.whole != '' THEN sha256(p.whole) END AS digest, k.license_id, coalesce(ids, '') AS notice_ids, coalesce(n, 0) AS n_notices FROM p LEFT JOIN k ON k.whole = p.whole AND p.whole != '' LEFT JOIN f ON f.doc_id = p.doc_id"""


#: All rebuilt conversations' prefixes, and every ancestor of every node, which the small tables allow.
PREFIX_TRIE = r"""WITH RECURSIVE o AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 d AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM o),
 c AS MATERIALIZED (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), range(0, 8 * len(s))), lambda a, i: xor(xor(a, CASE WHEN i % 8 = 0 THEN ord(s[i // 8 + 1]) ELSE 0 END) >> 1, CASE WHEN xor(a, CASE WHEN i % 8 = 0 THEN ord(s[i // 8 + 1]) ELSE 0 END) & 1 = 1 THEN 3988292384 ELSE 0 END))) % 6 AS h FROM d),
 b AS (SELECT c.conv_id, 0 AS part, n, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND n <= h UNION ALL SELECT conv_id, 1, n, role, text FROM c JOIN o USING (conv_id) WHERE n > h),
 r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, n) AS depth, CAST(to_json([role, text]) AS VARCHAR) AS turn, length(text) AS chars FROM b),
 w AS (SELECT conv_id, depth, sha256(string_agg(turn, chr(10)) OVER (PARTITION BY conv_id ORDER BY depth)) AS path, chars FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM c),
 m AS MATERIALIZED (SELECT conv_id, depth, path, chars, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM w),
 node AS MATERIALIZED (SELECT path, min(parent) AS parent, min(conv_id) AS conv_id, min(depth) AS depth, min(chars) AS chars, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM m GROUP BY 1),
 kids AS MATERIALIZED (SELECT parent, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY 1),
 up AS (SELECT path AS top, path AS below FROM node UNION ALL SELECT parent, below FROM up JOIN node ON path = top WHERE parent IS NOT NULL),
 sub AS (SELECT top, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM up JOIN node ON node.path = below LEFT JOIN kids ON kids.parent = below GROUP BY 1)
 SELECT node.conv_id, node.depth, p.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.ends_sha256
 FROM node JOIN sub ON sub.top = node.path LEFT JOIN kids ON kids.parent = node.path LEFT JOIN node p ON p.path = node.parent"""

#: The cheapest edits by a recursion over each conversation's rows; x0 to x3: least (cost, audit) of the grammar's states.
REPAIR = r"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') AS ck, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
 c AS MATERIALIZED (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), range(0, 8 * len(s))), lambda a, i: xor(xor(a, CASE WHEN i % 8 = 0 THEN ord(s[i // 8 + 1]) ELSE 0 END) >> 1, CASE WHEN xor(a, CASE WHEN i % 8 = 0 THEN ord(s[i // 8 + 1]) ELSE 0 END) & 1 = 1 THEN 3988292384 ELSE 0 END))) % 20 AS kind FROM o),
 d AS (SELECT ck, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE kind != 0),
 f AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY ck, role, text ORDER BY turn NULLS FIRST, copy) AS nth, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS ends FROM d),
 j AS MATERIALIZED (SELECT ck, turn, n, role, text, left(role, 1) AS r, CASE WHEN ends = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN ends NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY ck ORDER BY n) AS last FROM f),
 t AS (SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (last IS NOT NULL AND last || r NOT IN ('su', 'ua', 'au')) AS illegal FROM j GROUP BY 1),
 v AS (SELECT DISTINCT ck, CAST(0 AS BIGINT) AS n, {'c': CAST(0 AS BIGINT), 'a': ''} AS x0, {'c': CAST(1000000000 AS BIGINT), 'a': ''} AS x1, {'c': CAST(3 AS BIGINT), 'a': 'I'} AS x2, {'c': CAST(6 AS BIGINT), 'a': 'II'} AS x3 FROM j
  UNION ALL SELECT ck, n, y0, y1, z2, list_min([y3, {'c': z2.c + 3, 'a': z2.a || 'I'}]) FROM (SELECT *, list_min([y2, {'c': y0.c + 3, 'a': y0.a || 'I'}, {'c': y1.c + 3, 'a': y1.a || 'I'}, {'c': y3.c + 3, 'a': y3.a || 'I'}]) AS z2 FROM (
   SELECT ck, n, {'c': x0.c + 4, 'a': x0.a || 'D'} AS y0, list_min([{'c': x1.c + 4, 'a': x1.a || 'D'}, {'c': x0.c + ks, 'a': x0.a || 'K'}]) AS y1,
    list_min([{'c': x2.c + 4, 'a': x2.a || 'D'}] || list_transform([x0, x1, x3], lambda x: {'c': x.c + ku, 'a': x.a || 'K'}) || list_transform([x0, x1, x3], lambda x: {'c': x.c + kr, 'a': x.a || 'R'})) AS y2,
    list_min([{'c': x3.c + 4, 'a': x3.a || 'D'}, {'c': x2.c + ka, 'a': x2.a || 'K'}, {'c': x2.c + kr, 'a': x2.a || 'R'}]) AS y3
   FROM (SELECT j.ck, j.n, x0, x1, x2, x3, more + CASE r WHEN 's' THEN 0 ELSE 1000000000 END AS ks, more + CASE r WHEN 'u' THEN 0 ELSE 1000000000 END AS ku, more + CASE r WHEN 'a' THEN 0 ELSE 1000000000 END AS ka, more + 3 AS kr
    FROM v JOIN (SELECT *, CASE fault WHEN 'truncated' THEN 3 WHEN '' THEN 0 ELSE 1000000000 END AS more FROM j) j ON j.ck = v.ck AND j.n = v.n + 1)))),
 b AS MATERIALIZED (SELECT ck, best.c AS cost, best.a AS audit FROM (SELECT ck, list_min([x0, x3]) AS best FROM v QUALIFY n = max(n) OVER (PARTITION BY ck))),
 e AS (SELECT ck, i, audit[i] AS e FROM (SELECT ck, audit, unnest(range(1, len(audit) + 1)) AS i FROM b)),
 w AS (SELECT *, sum(CASE e WHEN 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY ck ORDER BY i) AS n FROM e),
 k AS (SELECT w.ck, i, e, role, text, r, row_number() OVER (PARTITION BY w.ck ORDER BY i) AS m FROM w LEFT JOIN j ON j.ck = w.ck AND j.n = w.n WHERE e != 'D'),
 q AS (SELECT *, first_value(e = 'K' AND r = 's') OVER (PARTITION BY ck ORDER BY m) AS led FROM k),
 h AS (SELECT ck, string_agg(CASE WHEN e = 'K' THEN role WHEN (m - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY m) AS said FROM q GROUP BY 1)
 SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id, ck FROM c) LEFT JOIN t USING (ck) LEFT JOIN b USING (ck) LEFT JOIN h USING (ck)"""

#: All 50-byte strings of all texts, as hexadecimal digits.
REPEATS = r"""WITH b AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 f AS (SELECT r, doc_id, length(h) // 2 AS n, unnest(range(0, length(h) // 2 - 49, 200)) AS j, h FROM b),
 c AS MATERIALIZED (SELECT r, doc_id, n, j, substr(h, 2 * j + 1, 498) AS part FROM f),
 p AS (SELECT r, doc_id, j, part, unnest(range(1, least(201, n - j - 48))) AS i FROM c),
 w AS MATERIALIZED (SELECT r, doc_id, j + i AS i, md5_number(substr(part, 2 * i - 1, 100)) AS x FROM p),
 l AS (SELECT x, min(doc_id) AS least FROM w GROUP BY 1),
 m AS MATERIALIZED (SELECT r, i FROM w JOIN l USING (x) WHERE doc_id > least),
 g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM m),
 n AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
 s AS (SELECT r, k, min(i) AS a, max(i) + 49 AS z FROM n GROUP BY 1, 2),
 q AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before, a, z FROM s),
 k AS (SELECT r, count(*) AS n_spans, sum(z - a + 1) AS n_removed, max(z) AS done, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS kept FROM q JOIN b USING (r) GROUP BY 1)
 SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(done, 0) + 1))) AS kept_sha256 FROM b LEFT JOIN k USING (r)"""


ORACLE_SQL = {"op2_neardup": NEARDUP, "op8_licenses": _licenses(), "op11_conversations": REPAIR, "op12_prefixtrie": PREFIX_TRIE, "op13_repeats": REPEATS}
