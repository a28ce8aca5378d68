"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from tonequarry.llm.embeddings import THRESHOLD
from tonequarry.llm.licenses import BAND, COVER, GRAM, NOTICES, PHRASES

_TEMPLATES = ", ".join(f"({k}, '{text}', '{label}', {phrase})" for k, (text, label, phrase) in enumerate([*((t, n, True) for t, n in PHRASES.items()), *((t, n, False) for n, t in NOTICES.items())]))

#: Labels by the definition: runs are joined as words, not by hash, and the distinct template places of a band of diagonals are counted.
LICENSES = rf"""WITH tmpl AS (SELECT template, label, phrase, str_split(body, ' ') AS ws FROM (VALUES {_TEMPLATES}) AS t(template, body, label, phrase)),
grams AS (SELECT template, label, phrase, len(ws) - {GRAM - 1} AS runs, place, array_to_string(ws[place + 1 : place + {GRAM}], ' ') AS gram FROM (SELECT *, unnest(range(0, len(ws) - {GRAM - 1})) AS place FROM tmpl)),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
placed AS (SELECT rid, unnest(ws) AS w, unnest(range(0, len(ws))) AS place FROM docs),
text_runs AS (SELECT rid, place, {" || ' ' || ".join(["w", *(f"lead(w, {k}) OVER (PARTITION BY rid ORDER BY place)" for k in range(1, GRAM))])} AS gram FROM placed),
votes AS MATERIALIZED (SELECT r.rid, template, r.place - g.place AS diagonal, r.place AS at_word, g.place, runs, label, phrase FROM text_runs r JOIN grams g USING (gram)),
diagonals AS (SELECT rid, template, diagonal, any_value(runs) AS runs, any_value(label) AS label, any_value(phrase) AS phrase, min(at_word) AS lo FROM votes GROUP BY 1, 2, 3),
judged AS (SELECT d.rid, d.template, d.diagonal, d.label, d.phrase, d.lo, max(v.at_word) AS hi, count(DISTINCT v.place)::DOUBLE / d.runs AS share
 FROM diagonals d JOIN votes v ON v.rid = d.rid AND v.template = d.template AND v.diagonal BETWEEN d.diagonal AND d.diagonal + CASE WHEN d.phrase THEN 0 ELSE {BAND} END GROUP BY d.rid, d.template, d.diagonal, d.label, d.phrase, d.lo, d.runs),
hits AS MATERIALIZED (SELECT * FROM judged WHERE share >= CASE WHEN phrase THEN 1 ELSE {COVER}::DOUBLE END),
best AS (SELECT * FROM hits h WHERE phrase OR NOT EXISTS (SELECT 1 FROM hits o WHERE o.rid = h.rid AND o.label <> h.label AND o.share > h.share AND o.lo < h.hi + {GRAM} AND h.lo < o.hi + {GRAM})),
told AS (SELECT rid, count(*) FILTER (phrase) AS n_base, min(lo) FILTER (phrase) AS first_word, max(lo) FILTER (phrase) AS last_word,
 list_sort(list(DISTINCT label) FILTER (phrase)) AS bl, list_sort(list(DISTINCT label)) AS ml, max(share) AS score FROM best GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
 coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(ml, ','), '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM docs LEFT JOIN told USING (rid)"""

#: All pairs by brute force, then the smallest id reached over links.
EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, len(e) AS dim, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM v
 WHERE vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.dim = b.dim AND a.vec_id <> b.vec_id AND list_inner_product(a.u, b.u) >= {THRESHOLD}::DOUBLE),
reach AS (SELECT a AS node, a AS root FROM (SELECT DISTINCT a FROM links) UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(coalesce(root, vec_id) = vec_id, false) AS kept FROM v LEFT JOIN comp ON node = vec_id LEFT JOIN n ON n.a = vec_id"""

#: Every prefix as a list of turns; crc32 bit by bit; each node counts for all prefixes of its own path.
PREFIX_TRIE = """WITH RECURSIVE ordered AS MATERIALIZED (SELECT conv_id, {'role': coalesce(role, ''), 'body': coalesce(text, '')} AS said,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS d FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT conv_id, list(said ORDER BY d) AS seq FROM ordered GROUP BY 1),
crc AS (SELECT conv_id, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM own
 UNION ALL SELECT conv_id, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END
 FROM (SELECT conv_id, i, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(CAST(conv_id AS VARCHAR)[i // 8 + 1]) AS BIGINT)) ELSE c END AS x FROM crc WHERE i < 8 * length(CAST(conv_id AS VARCHAR)))),
h AS (SELECT conv_id, xor(c, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE i = 8 * length(CAST(conv_id AS VARCHAR))),
rebuilt AS MATERIALIZED (SELECT o.conv_id, list_concat(coalesce(b.seq[1 : h.h], []), o.seq[h.h + 1 :]) AS seq FROM own o JOIN h USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
paths AS (SELECT conv_id, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS d, seq FROM rebuilt),
nodes AS MATERIALIZED (SELECT seq[1 : d] AS path, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends FROM paths GROUP BY 1, 2),
costs AS MATERIALIZED (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[d].body) END AS cost, NOT EXISTS (SELECT 1 FROM nodes k WHERE k.d = n.d + 1 AND k.path[1 : n.d] = n.path) AS leaf FROM nodes n),
rolled AS (SELECT path[1 : k] AS path, sum(cost) AS saved, count(*) FILTER (leaf) AS leaves, count(*) FILTER (d = k + 1) AS children FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM costs) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, children AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN rolled USING (path) LEFT JOIN nodes p ON n.d = p.d + 1 AND n.path[1 : p.d] = p.path"""

#: Ranks are put in order as a whole; sources that are above their limit are the first by size over weight.
MIXING = r"""WITH docs AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
 (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM documents),
classed AS MATERIALIZED (SELECT *, length(bin(size)) AS propensity FROM docs),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM docs GROUP BY source),
levels AS (SELECT *, (sum(size) OVER () - 3 * coalesce(sum(size) OVER before, 0)) AS share, sum(weight) OVER rest AS whole FROM src
 WINDOW before AS (ORDER BY size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT share, whole FROM levels WHERE NOT CAST(share * weight AS DOUBLE) / whole > 3 * size ORDER BY size / weight, source LIMIT 1),
aims AS (SELECT source, size AS source_size, least(CAST(share * weight AS DOUBLE) / whole, CAST(3 * size AS DOUBLE)) AS target FROM src, level),
sums AS (SELECT source, propensity, CAST(sum(size) AS BIGINT) AS words FROM classed GROUP BY ALL),
rates AS (SELECT s.source, propensity, words, source_size, target, (target - 3 * coalesce(sum(words) OVER before, 0)) / sum(words * propensity) OVER rest AS rate, sum(words * propensity) OVER rest AS left_over
 FROM sums s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
 WINDOW before AS (PARTITION BY s.source ORDER BY propensity DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (PARTITION BY s.source ORDER BY propensity DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
held AS (SELECT *, CASE WHEN left_over > 0 THEN rate ELSE 0 END AS r FROM rates),
free AS (SELECT source, max(propensity) AS top, arg_max(r, propensity) AS r FROM held WHERE r * propensity < 3 GROUP BY source),
copies AS (SELECT h.*, CASE WHEN f.top IS NULL OR h.propensity > f.top THEN 3.0::DOUBLE ELSE least(f.r * h.propensity, 3.0::DOUBLE) END AS n FROM held h LEFT JOIN free f ON h.source IS NOT DISTINCT FROM f.source),
plan AS (SELECT source, propensity, source_size, target, CAST(floor(n) AS BIGINT) AS whole, n - floor(n) AS p, target - sum(words * CAST(floor(n) AS BIGINT)) OVER (PARTITION BY source) AS left_over FROM copies),
ranked AS (SELECT doc_id, d.source, size, source_size, target, whole, left_over, CASE WHEN p > 0 AND size > 0 THEN u / (1 - u) * ((1 - p) / p) END AS rank
 FROM classed d JOIN plan q ON d.source IS NOT DISTINCT FROM q.source AND d.propensity = q.propensity),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN rank IS NOT NULL AND 2 * before + size <= 2 * left_over THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed"""
