"""The operators' queries and their SQL."""

from __future__ import annotations

from threadloom.llm.cascade import op12_rule_cascade
from threadloom.llm.decontamination import op6_template_leaks
from threadloom.llm.hidden_markov import op9_hidden_markov
from threadloom.llm.jaccard import op4_jaccard_components
from threadloom.llm.mixing import op2_entropy_mix
from threadloom.llm.negatives import op11_secondary_sort_negatives
from threadloom.llm.pii import op1_pii_boosting
from threadloom.llm.quality import op8_quality_qda
from threadloom.llm.repeats import op7_seed_extend
from threadloom.llm.secrets import op3_secret_automaton
from threadloom.llm.sharding import op10_histogram_shards
from threadloom.llm.spelling import op13_composed_variants
from threadloom.llm.telephony import op5_telephony_media

QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_boosting,
        op2_entropy_mix,
        op3_secret_automaton,
        op4_jaccard_components,
        op5_telephony_media,
        op6_template_leaks,
        op7_seed_extend,
        op8_quality_qda,
        op9_hidden_markov,
        op10_histogram_shards,
        op11_secondary_sort_negatives,
        op12_rule_cascade,
        op13_composed_variants,
    )
}
WORDS_SQL = r"'[^\x20\x09-\x0D]+'"
# Models, automata and solvers are beyond SQL: tests compare these with brute force, exact round trips and held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_components": f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), {WORDS_SQL}) AS l FROM documents),
s AS (SELECT DISTINCT r, array_to_string(l[i:i+3], ' ') AS x FROM (SELECT r, l, unnest(range(1, greatest(len(l) - 3, 1) + 1)) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
c AS (SELECT r, r AS t FROM w UNION SELECT c.r, e.b FROM c JOIN e ON e.a = c.t),
m AS (SELECT c.r, min(w.doc_id) AS component_id FROM c JOIN w ON w.r = c.t GROUP BY c.r)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w JOIN m USING (r) LEFT JOIN n USING (r)""",
    "op7_seed_extend": f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text,''), {WORDS_SQL}) AS l FROM documents),
v AS (SELECT r, i, array_to_string(l[i:i+34], ' ') AS x FROM (SELECT r, l, unnest(range(1, len(l) - 33)) AS i FROM w WHERE len(l) >= 35)),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM v WHERE x IN (SELECT x FROM v GROUP BY x HAVING count(*) > 1)),
k AS (SELECT r, p, x FROM (SELECT r, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS p FROM w) ANTI JOIN g USING (r, p)),
o AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM k GROUP BY r)
SELECT doc_id, len(l) AS n_words, len(l) - coalesce(o.n, 0) AS n_removed, sha256(coalesce(o.t, '')) AS kept_sha256 FROM w LEFT JOIN o USING (r)""",
    "op11_secondary_sort_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, s.b AS n, p.s AS ps, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INT) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 10""",
    "op12_rule_cascade": f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS_SQL}) AS l FROM documents),
d AS (SELECT *, len(l) AS n, len(array_to_string(l, '')) AS chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS sym, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
v AS (SELECT r, i, array_to_string(l[i:i+2], ' ') AS x FROM (SELECT r, l, unnest(range(1, len(l) - 1)) AS i FROM w WHERE len(l) >= 3)),
g AS (SELECT r, count(DISTINCT p) AS rep FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS k FROM v) WHERE k > 1) GROUP BY r),
u AS (SELECT r, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS p FROM w),
q AS (SELECT r, count(*) FILTER (WHERE regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')) AS letters, count(*) FILTER (WHERE len(regexp_extract_all(x, '[A-Z]')) >= 2 AND NOT regexp_matches(x, '[a-z]')) AS caps,
 count(*) FILTER (WHERE right(x, 1) IN ('!', '?')) AS excl, count(*) FILTER (WHERE x = y) AS same FROM (SELECT r, x, lag(x) OVER (PARTITION BY r ORDER BY p) AS y FROM u) GROUP BY r),
o AS (SELECT r, max(k) AS top FROM (SELECT r, x, count(*) AS k FROM u GROUP BY r, x) GROUP BY r),
a AS (SELECT d.*, coalesce(rep, 0) AS rep, len(lines) - len(list_distinct(lines)) AS dup, n < 50 OR 100 * coalesce(rep, 0) > 50 * n AS failed FROM d LEFT JOIN g USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(sym AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words, failed AS base_failed,
 NOT (failed OR chars < 2 * n OR chars > 12 * n OR 10 * sym > n OR 10 * letters < 8 * n OR 10 * caps > 3 * n OR 10 * excl > 3 * n OR 2 * dup > len(lines) OR 10 * same > n OR 10 * top > 3 * n) AS kept FROM a LEFT JOIN q USING (r) LEFT JOIN o USING (r)""",
}
