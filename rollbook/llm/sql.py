"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from rollbook.llm.secret_index import BASE_RULES, MORE_RULES, Rule

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(m.m, v.vec_id)) AS component_id, least(v.vec_id, coalesce(m.m, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) n ON n.a = v.vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) m ON m.a = v.vec_id"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BENCHMARK = f"""
WITH it AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, w, least(10, len(w)) AS l FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) x WHERE len(w) > 0),
win AS (SELECT item, l, j, array_to_string(w[j + 1:j + l], ' ') AS s FROM it, unnest(range(0, len(w) - l + 1)) t(j)),
doc AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
place AS (SELECT doc_id, l, i, array_to_string(w[i + 1:i + l], ' ') AS s FROM (SELECT * FROM doc, (SELECT DISTINCT l FROM win) k) d, unnest(range(0, len(w) - l + 1)) t(i)),
hits AS (SELECT p.doc_id, p.i, p.l, w.item, w.j FROM place p JOIN win w ON w.l = p.l AND w.s = p.s),
runs AS (SELECT doc_id, count(*) + l - 1 AS n FROM (SELECT DISTINCT doc_id, l, item, j - i AS shift, i, i - dense_rank() OVER (PARTITION BY doc_id, l, item, j - i ORDER BY i) AS island FROM hits) h GROUP BY doc_id, l, item, shift, island),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hits, unnest(range(0, l)) t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(w.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(w.n, 0) > 0 AS contaminated,
 coalesce(r.n, 0) AS longest_match
FROM doc d LEFT JOIN words w ON w.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, max(n) AS n FROM runs GROUP BY doc_id) r ON r.doc_id = d.doc_id"""

MIX = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  -ln((CAST('0x' || substr(md5('7:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 1.0::DOUBLE) / 4503599627370496.0::DOUBLE)
   / greatest(0.05::DOUBLE, coalesce(CAST(length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS DOUBLE) / nullif(length(text), 0), 0.0)) AS waiting FROM documents),
s AS (SELECT source, sum(size) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM s),
r AS (SELECT *, (total - coalesce(sum(cap) OVER w, 0.0)) / (weights - coalesce(sum(weight) OVER w, 0)) AS level FROM c
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, cap / weight) AS level FROM r WHERE level <= cap / weight),
g AS (SELECT r.source, r.source_size, least(r.cap, coalesce(f.level * r.weight, r.cap)) AS target FROM r LEFT JOIN f ON TRUE),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g)
SELECT d.doc_id, d.source, CAST(d.size AS BIGINT) AS size, CAST(e.source_size AS BIGINT) AS source_size, e.target,
 CAST(e.epochs * d.size + greatest(0, least(d.size, floor(e.target) - e.epochs * e.source_size - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.waiting, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM d JOIN e ON e.source IS NOT DISTINCT FROM d.source"""


def _spans(rule: Rule, order: int) -> str:
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, {pattern})) + 1), lambda i: {{
 'a': CAST(list_sum(list_transform(string_split_regex(t, {pattern})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {pattern})[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
 'b': {order}, 'k': '{rule.kind}', 'n': length(regexp_extract_all(t, {pattern})[i]), 'g': length(regexp_extract_all(t, {pattern}, {rule.group})[i])}}), lambda x: x.g >= {rule.least})"""


def _joined(lists: list[str]) -> str:
    every = "list_sort(flatten([" + ", ".join(lists) + "]))"
    return f"array_to_string(list_transform({every}, lambda x: x.k || ':' || x.a || ':' || (x.a + x.n)), ',')"


_KINDS = [f"s_{r.kind}" for r in (*BASE_RULES, *MORE_RULES)]

SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {', '.join(f"{_spans(r, n)} AS s_{r.kind}" for n, r in enumerate((*BASE_RULES, *MORE_RULES)))} FROM d)
SELECT doc_id, {', '.join(f"CAST(len(s_{r.kind}) AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)},
 sha256({_joined(_KINDS[: len(BASE_RULES)])}) AS base_sha256, {_joined(_KINDS)} AS spans FROM f"""

PHRASES = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang),
inner_of AS (SELECT DISTINCT lang, phrase, f FROM (
  SELECT lang, f, unnest([array_to_string(split(phrase, ' ')[1:k - 1], ' '), array_to_string(split(phrase, ' ')[2:k], ' ')]) AS phrase
  FROM f WHERE k > 2)),
c AS (SELECT f.* FROM f ANTI JOIN inner_of USING (lang, phrase, f) WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM c JOIN (SELECT unnest(range(1, 5)) AS j) ON j < c.k JOIN n USING (lang)
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(split(c.phrase, ' ')[1:j], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(split(c.phrase, ' ')[j + 1:c.k], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000
"""
