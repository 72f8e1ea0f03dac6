"""SQL twins, for DuckDB over the given tables, of the queries that SQL can express.

They follow the contracts by plain grouping and counting and share no step with the
operators. Pieces of the tables of rules and patterns are filled in from the operators.
"""

from __future__ import annotations

from fleetgrain.llm import quality_rules as q
from fleetgrain.llm import secret_scan as s

_BLANKS = r"[\x20\x09-\x0D]+"


def quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in q.STOP_WORDS)
    checks = []
    for r in q.RULES:
        holds = [f"{r.metric} >= {r.low}"] * (r.low is not None) + [f"{r.metric} <= {r.high}"] * (r.high is not None)
        checks.append(f"({' AND '.join(holds)} OR n_words < {r.from_words}) AS ok_{r.name}")
    names = ", ".join(f"ok_{r.name}" for r in q.RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_BLANKS}'), lambda x: x <> '') AS w FROM d),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS g
      FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL) z WHERE c > 1),
r AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM f) z GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
s AS (SELECT doc_id, count(*) FILTER (lower(x) IN ({stop})) AS n_stop_words,
             count(*) FILTER (length(x) > 1 AND x = upper(x) AND x <> lower(x)) AS n_capital_words, sum(length(x)) AS word_chars FROM u GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_capital_words, 0) AS n_capital_words,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines
      FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)),
a AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_length, n_symbols / greatest(n_words, 1) AS symbol_ratio,
             n_stop_words / greatest(n_words, 1) AS stop_word_ratio, n_capital_words / greatest(n_words, 1) AS capital_ratio,
             n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
k AS (SELECT *, {', '.join(checks)} FROM a)
SELECT *, NOT base_failed AND {names.replace(', ', ' AND ')} AS kept FROM k"""


def warc_sql() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM x)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""


def exact_sql() -> str:
    return rf"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_BLANKS}', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""


def secret_sql() -> str:
    parts = []
    for i, k in enumerate(s.KINDS):
        pattern = k.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, owner, t, {i} AS kind, '{k.name}' AS name, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}', 0) AS m, "
            f"regexp_extract_all(t, '{pattern}', {k.group}) AS v, {k.least} AS least FROM d WHERE regexp_matches(t, '{pattern}')"
        )
    counts = ", ".join(f"CAST(count(*) FILTER (kind = {i}) AS BIGINT) AS n_{k.name}" for i, k in enumerate(s.BASE))
    return f"""
WITH d AS (SELECT doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
k AS ({' UNION ALL '.join(parts)}),
n AS (SELECT doc_id, owner, kind, name, least, generate_subscripts(m, 1) AS j, unnest(m) AS m, unnest(v) AS v, unnest(p[1:len(m)]) AS p FROM k),
c AS (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY j) AS e FROM n),
s AS (SELECT doc_id, owner, kind, name, v, e - length(m) AS b, e FROM c WHERE length(v) >= least),
o AS (SELECT v, count(DISTINCT owner) AS n_owners FROM s GROUP BY 1),
h AS (SELECT doc_id, count(*) FILTER (n_owners <= {s.MOST_OWNERS}) AS n_live, count(*) FILTER (n_owners > {s.MOST_OWNERS}) AS n_example
      FROM (SELECT DISTINCT doc_id, v FROM s) JOIN o USING (v) GROUP BY 1),
t AS (SELECT doc_id, {counts},
             string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind) FILTER (kind < {len(s.BASE)}) AS base, string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind) AS spans
      FROM s GROUP BY 1)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k.name}, 0) AS n_{k.name}' for k in s.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN t USING (doc_id) LEFT JOIN h USING (doc_id)"""


def suffix_sql() -> str:
    return """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
p AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS x FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS i FROM n) z),
q AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM p) z WHERE r > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= b THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 AS b FROM q) z),
r AS (SELECT doc_id, run, min(i) AS b, max(i) + 100 AS e FROM g GROUP BY 1, 2),
k AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a FROM r),
t AS (SELECT k.doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY b) || substr(any_value(h), CAST(2 * max(e) + 1 AS BIGINT)) AS kept
      FROM k JOIN n USING (doc_id) GROUP BY 1)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN t USING (doc_id)"""


def ngram_sql() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANKS}'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d WHERE len(w) >= 4),
g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o AS g FROM u
      WINDOW o AS (PARTITION BY doc_id ORDER BY i)) z WHERE g IS NOT NULL
      UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.r = e.a)
SELECT c.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id FROM c LEFT JOIN n USING (doc_id) GROUP BY 1"""


def negatives_sql() -> str:
    return """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5"""


def substring_sql() -> str:
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d) z),
q AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM g) z WHERE first < doc_id),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM q),
n AS (SELECT doc_id, count(*) AS n_spans FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM r) z WHERE b IS NULL OR b < i - 1 GROUP BY 1),
k AS (SELECT u.doc_id, count(*) AS n_words, count(r.i) AS n_removed, string_agg(x, ' ' ORDER BY u.i) FILTER (r.i IS NULL) AS kept FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND r.i = u.i GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""


def all_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_sql(),
        "op4_warc": warc_sql(),
        "op5_exact_dedup": exact_sql(),
        "op6_secret_scan": secret_sql(),
        "op7_suffix_dedup": suffix_sql(),
        "op10_ngram_join": ngram_sql(),
        "op12_hard_negatives": negatives_sql(),
        "op13_substring_dedup": substring_sql(),
    }
