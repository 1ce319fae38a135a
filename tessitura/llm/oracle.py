"""DuckDB SQL for the queries that SQL can express, by brute force.

Not here: 1, 9 and 11 (fitted models), 2 (byte strings), 4 (XXH64), 10 (a tokenizer) and the pipeline that holds them; tests/llm hold those
against plain Python.
"""

from __future__ import annotations

import string

from tessitura.llm.licenses import PHRASES, table
from tessitura.llm.secrets import BASE, RULES, java

q = lambda s: "'" + s.replace("'", "''") + "'"
LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
WORDS = rf"regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRINGS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
  again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
  gone AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS p FROM again),
  spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < p - 1) AS n_spans FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY 1),
  kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
  SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)"""

CONTAMINATION = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
  win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
  spot AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
  hit AS (SELECT doc_id, item_id, i, n FROM spot JOIN win USING (n, k)), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(n)) AS p FROM hit) GROUP BY 1),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _secrets() -> str:
    parts = []
    for at, rule in enumerate(RULES):
        p = q(java(rule))
        parts.append(
            f"SELECT doc_id, {at} AS o, '{rule.kind}' AS kind, list_sum(list_transform(b[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s, length(m[i]) AS n, length(g[i]) AS c, {rule.least} AS least FROM "
            f"(SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {rule.group}) AS g, string_split_regex(t, {p}) AS b FROM d WHERE regexp_matches(t, {p})))"
        )
    counts = ", ".join(f"count(*) FILTER (o = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    named = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    span = "kind || ':' || s || ':' || (s + n)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE c >= least),
  each AS (SELECT doc_id, {counts}, string_agg({span}, ',' ORDER BY s, o) FILTER (o < {len(BASE)}) AS b, string_agg({span}, ',' ORDER BY s, o) AS a FROM found GROUP BY 1)
  SELECT doc_id, {named}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN each USING (doc_id)"""


def _licenses() -> str:
    phrases = []
    for p, label in PHRASES.items():
        ws = p.split(" ")
        at = " AND ".join(f"w[i + {j}] = {q(x)}" for j, x in enumerate(ws))
        phrases.append(f"SELECT doc_id, i - 1 AS p, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE {at}")
    rows = ", ".join(f"({at}, {q(label)}, {q(t)}, {need}, {len(ws)}, {width})" for at, (label, ws, need, width) in enumerate(table()) for t in ws)
    return f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), tok(tmpl, label, x, need, size, width) AS (VALUES {rows}), base AS ({' UNION ALL '.join(phrases)}),
  every AS (SELECT doc_id, tmpl, label, need, size, width, x, p FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM d) JOIN tok USING (x)), enough AS (SELECT doc_id, tmpl FROM every GROUP BY 1, 2 HAVING count(DISTINCT x) >= any_value(need)),
  places AS (SELECT * FROM every SEMI JOIN enough USING (doc_id, tmpl)), block AS (SELECT a.doc_id, a.label, a.tmpl, a.p, count(DISTINCT b.x) AS n, any_value(a.size) AS size FROM places a JOIN places b ON a.doc_id = b.doc_id AND a.tmpl = b.tmpl AND b.p >= a.p AND b.p < a.p + a.width GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT b.x) >= any_value(a.need)),
  more AS (SELECT doc_id, label, max(n / size::DOUBLE) AS share, count(*) AS blocks FROM block GROUP BY 1, 2),
  b1 AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY 1),
  l1 AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM more) GROUP BY 1), s1 AS (SELECT doc_id, max(share) AS share, sum(blocks) AS blocks FROM more GROUP BY 1)
  SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score, CAST(coalesce(blocks, 0) AS BIGINT) AS n_blocks
  FROM d LEFT JOIN b1 USING (doc_id) LEFT JOIN l1 USING (doc_id) LEFT JOIN s1 USING (doc_id)"""


VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), g AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
  reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.id),
  c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
  SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = vec_id AS kept FROM v JOIN c ON id = vec_id LEFT JOIN n ON a = vec_id"""

PHRASE_COUNTS = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
  total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1), k AS (SELECT unnest([1, 2, 3]) AS k),
  f AS MATERIALIZED (SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, k WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 10),
  cut AS (SELECT lang, k, p, f, j, p[1:j] AS head, p[j + 1:k] AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1)),
  s AS (SELECT c.lang, c.k, c.p, c.f AS a, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS BIGINT) AS score, j FROM cut c JOIN f x ON x.lang = c.lang AND x.p = c.head JOIN f y ON y.lang = c.lang AND y.p = c.tail),
  least AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
  inside AS (SELECT lang, p, max(f) AS longer FROM (SELECT lang, f, p[1:2] AS p FROM f WHERE k = 3 UNION ALL SELECT lang, f, p[2:3] FROM f WHERE k = 3) GROUP BY 1, 2),
  kept AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM least LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR 100 * longer < 50 * a)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang) QUALIFY rank <= 2000"""


def _codes() -> str:
    """Lloyd's rounds written out one after the other."""
    distance = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    steps = []
    for t in range(5):
        steps.append(f"a{t} AS MATERIALIZED (SELECT vec_id, label, p, arg_min(j, d * 256 + j) AS j, min(d) AS d FROM (SELECT vec_id, label, p, j, {distance} AS d FROM parts JOIN b{t} USING (p)) GROUP BY ALL)")
        if t < 4:
            steps.append(f"m{t} AS (SELECT p, j, pos, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT p, j, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{t} JOIN parts USING (vec_id, label, p)) GROUP BY ALL)")
            steps.append(f"b{t + 1} AS MATERIALIZED (SELECT p, j, coalesce(new, c) AS c FROM b{t} LEFT JOIN (SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS new FROM m{t} GROUP BY ALL) USING (p, j))")
    return f"""WITH v AS (SELECT vec_id, coalesce(label, -1) AS label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  parts AS MATERIALIZED (SELECT vec_id, label, p, e[p * len(e) // 4 + 1:(p + 1) * len(e) // 4] AS x FROM (SELECT *, unnest(range(4)) AS p FROM v)),
  b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, x AS c FROM parts QUALIFY j < 256), {', '.join(steps)},
  one AS (SELECT vec_id, label, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY ALL), book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b4)
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM one, book"""


SQL: dict[str, str] = {
    "op3_secrets": _secrets(),
    "op5_licenses": _licenses(),
    "op6_decontamination": CONTAMINATION,
    "op7_embeddings": VECTORS,
    "op8_substrings": SUBSTRINGS,
    "op12_collocations": PHRASE_COUNTS,
    "op13_vector_codes": _codes(),
}
