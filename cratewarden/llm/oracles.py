"""DuckDB SQL with the rows of those corpus queries that SQL can express. Written apart from the operators."""

from __future__ import annotations

from . import mixing, quality

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP4 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM again, range(0, 50) r(j)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_symbols = r"length(regexp_replace({0}, '[^#*$%&|<>]+', '', 'g'))"
_passes = rf"""NOT ((length(regexp_replace(l, '[^|»›•·]+', '', 'g')) >= 3 AND length(regexp_replace(l, '[^|»›•·]+', '', 'g')) * 40 > length(l))
 OR {_symbols.format("l")} * 8 > length(l) OR (length(regexp_replace(l, '[^!]+', '', 'g')) >= 4 AND length(regexp_replace(l, '[^!]+', '', 'g')) * 15 > length(l))
 OR (length(l) < 160 AND regexp_matches(l, '{quality.BOILERPLATE.replace(chr(39), chr(39) * 2)}'))
 OR (length(l) < 30 AND NOT regexp_matches(l, '{quality.SENTENCE_END.replace(chr(39), chr(39) * 2)}')))"""

OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 8) r(j) GROUP BY 1),
lines AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
per AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dups, coalesce(sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) FILTER ({_passes}), 0) AS clean FROM lines GROUP BY 1),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({_symbols.format("text")} AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(clean, 0) AS clean FROM d LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND clean >= {quality.MIN_KEPT} * word_chars AS kept FROM f
"""

_ramp = f"list_extract({list(mixing.RAMPS)}, CAST(weight AS INT))"
OP6 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || coalesce(source, '') || '/' || coalesce(text, '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (SELECT *, row_number() OVER q AS rk, (total - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM w WINDOW q AS (ORDER BY cap / weight, source NULLS LAST), before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN level * weight >= cap THEN cap ELSE (SELECT arg_min(level, rk) FROM l WHERE level * weight < cap) * weight END AS target FROM l),
r AS (SELECT d.doc_id, d.size, source_size, target, weight, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CAST(whole + CASE WHEN off + size / 2.0::DOUBLE < target - whole * source_size THEN 1 ELSE 0 END AS INT) AS copies, CASE WHEN target > 0 THEN least(off / target, 1.0) ELSE 0.0 END AS u FROM r)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies, CASE WHEN copies > 0 THEN round(CASE WHEN u <= 0 THEN 0.0 ELSE 2 * u / ((1 - {_ramp}) + sqrt((1 - {_ramp}) * (1 - {_ramp}) + 4 * {_ramp} * u)) END, 9) END AS first_position FROM x
"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
c AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d WHERE len(t) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(t) * docs) // words) AS m FROM d, c WHERE len(t) > 0),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

_nearest = """{0} AS (SELECT i, p, arg_min(e, dist * 100 + e) AS e, min(dist) AS dist FROM (SELECT v.i, v.p, b.e, CAST(sum((v.x - b.x) * (v.x - b.x)) AS BIGINT) AS dist FROM v JOIN {1} b USING (p, k) GROUP BY v.i, v.p, b.e) GROUP BY i, p),"""
_refined = """{0} AS (SELECT b.p, b.e, b.k, coalesce(n.x, b.x) AS x FROM {1} b LEFT JOIN (SELECT v.p, e, k, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x FROM v JOIN {2} USING (i, p) GROUP BY ALL) n USING (p, e, k)),"""
OP13 = f"""
WITH rows AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS i, vec_id, label, embedding AS y FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
v AS MATERIALIZED (SELECT i, j * 16 // n AS p, j - (j * 16 // n) * n // 16 AS k, CAST(floor(256 * x::DOUBLE) AS BIGINT) AS x FROM (SELECT i, len(y) AS n, unnest(y) AS x, unnest(range(len(y))) AS j FROM rows)),
b0 AS (SELECT p, i AS e, k, x FROM v WHERE i < 64),
{_nearest.format("n0", "b0")} {_refined.format("b1", "b0", "n0")}
{_nearest.format("n1", "b1")} {_refined.format("b2", "b1", "n1")}
{_nearest.format("n2", "b2")}
c AS (SELECT i, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM n2 GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, k)) FROM b2) AS codebooks_sha256 FROM rows JOIN c USING (i)
"""

SQL = {"op4_substrings": OP4, "op5_quality": OP5, "op6_mixing": OP6, "op12_lexical": OP12, "op13_codes": OP13}
