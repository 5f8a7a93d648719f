"""DuckDB SQL for the corpus queries that SQL can express, written from their contracts rather than their plans."""

WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0) q, v c
  WHERE c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text, md5(coalesce(text, '')) AS digest, {WORDS.format("text")} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
counts AS (
  SELECT row, doc_id, source, digest, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM d),
w AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
windows AS (
  SELECT * FROM (SELECT row, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY row ORDER BY i)) WHERE c IS NOT NULL),
twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, a, b, c) > 1),
repeats AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) t(k) GROUP BY row),
line AS (SELECT row, source, digest, {WORDS.format("l")} AS lw FROM (SELECT row, source, digest, unnest(lines) AS l FROM d)),
norm AS (SELECT row, source, digest, {ASCII_LOWER.format("array_to_string(lw, ' ')")} AS line, len(lw) AS n FROM line WHERE len(lw) >= 3),
own AS (SELECT source, digest, line, max(n) AS n FROM (SELECT row, source, digest, line, sum(n) AS n FROM norm GROUP BY ALL) GROUP BY source, digest, line),
frequent AS (SELECT source, line FROM own GROUP BY source, line HAVING count(*) > 25),
lost AS (SELECT o.source, o.digest, sum(o.n) AS removed FROM own o JOIN frequent f ON o.source IS NOT DISTINCT FROM f.source AND o.line = f.line GROUP BY 1, 2),
judged AS (
  SELECT doc_id, c.n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0) AS removed_words,
    c.n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * c.n_words AS base_failed
  FROM counts c LEFT JOIN repeats r ON c.row = r.row LEFT JOIN lost l ON c.source IS NOT DISTINCT FROM l.source AND c.digest = l.digest)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND 100 * (n_words - removed_words) >= 30 * n_words AS kept, CAST(removed_words AS BIGINT) AS removed_words FROM judged
"""

URLS = rf"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT row_number() OVER () AS row, page_id, {ASCII_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM r)),
rules(h, p, kind) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT row, h || rules.p AS rule, kind FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(h) + length(rules.p) DESC, length(h) DESC, kind DESC) = 1)
SELECT page_id, host, path, rule, coalesce(kind, 'allow') AS verdict FROM p LEFT JOIN fit USING (row)
"""

MIX = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, len({WORDS.format("text")}) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
per AS (SELECT source, sum(size) AS source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM d GROUP BY source),
steps AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level,
    row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k
  FROM per WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT source, source_size, coalesce(least(2.0 * source_size, (SELECT arg_min(level, k) FROM steps WHERE level * weight <= 2.0 * source_size) * weight), 2.0 * source_size) AS target FROM steps),
bounds AS (
  SELECT source, need, floor(sum(need) OVER (ORDER BY source NULLS LAST) / sum(need) OVER () * 2147483648) AS hi FROM (SELECT source, floor(target) AS need FROM held) WHERE need > 0),
shares AS (SELECT source, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo, hi FROM bounds),
b AS (SELECT CAST(greatest(1, least(1024, CAST(sum(floor(target)) AS BIGINT) // greatest(65536, 256 * count(*)))) AS BIGINT) AS block, CAST(sum(floor(target)) AS BIGINT) AS every FROM held),
slots AS (SELECT k AS slot, k % 2147483648 * 1327217885 % 2147483648 AS point FROM (SELECT unnest(range(CAST(ceil(every / block) AS BIGINT))) AS k FROM b)),
drawn AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM slots JOIN shares ON point >= lo AND point < hi),
laid AS (
  SELECT d.*, source_size, target, least(2 * source_size, coalesce(n, 0) * block) AS most, block, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size, row) - size AS start
  FROM d JOIN held h ON d.source IS NOT DISTINCT FROM h.source LEFT JOIN (SELECT source, count(*) AS n FROM drawn GROUP BY source) c ON d.source IS NOT DISTINCT FROM c.source, b),
ends AS (SELECT *, least(start + size, most) AS e1, start + source_size AS start2, least(start + source_size + size, most) AS e2 FROM laid),
pieces AS (
  SELECT *, greatest(0, e1 - start) + greatest(0, e2 - start2) AS taken, CASE WHEN e1 > start THEN (e1 - 1) // block - start // block + 1 ELSE 0 END + CASE WHEN e2 > start2 THEN (e2 - 1) // block - start2 // block + 1 ELSE 0 END AS n_slots FROM ends)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target, CAST(taken AS BIGINT) AS taken, CAST(n_slots AS BIGINT) AS n_slots, slot AS first_slot
FROM pieces p LEFT JOIN drawn x ON p.source IS NOT DISTINCT FROM x.source AND x.rank = p.start // block AND p.e1 > p.start
"""

KEPT = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def lloyd_round(k: int, by: str = "") -> str:
    """Assignment to c{k} and the centroids c{k+1} after it; by: what besides the number tells centroids apart."""
    same = " AND x.part = c.part" if by else ""
    return f"""
d{k} AS (SELECT {"x.part, " if by else ""}row, number, list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v) AS d FROM x JOIN c{k} c ON true{same}),
a{k} AS (SELECT {by}row, arg_min(number, struct_pack(d := d, n := number)) AS number, CAST(min(d) AS BIGINT) AS distance FROM d{k} GROUP BY ALL),
s{k} AS (SELECT {by}number, k, floor(CAST(sum(y) AS DOUBLE) / count(*)) AS y FROM (SELECT {by}number, unnest(v) AS y, generate_subscripts(v, 1) AS k FROM a{k} JOIN x USING ({by}row)) GROUP BY ALL),
c{k + 1} AS (SELECT {by}number, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT {by}number, list(y ORDER BY k) AS v FROM s{k} GROUP BY ALL) m USING ({by}number))"""


CODES = f"""
WITH q AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS row, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {KEPT})),
x AS (SELECT row, part, v[part * w + 1 : part * w + w] AS v FROM (SELECT row, v, len(v) // 16 AS w, unnest(range(16)) AS part FROM q)),
c0 AS (SELECT part, row - 1 AS number, v FROM x WHERE row <= 64),{lloyd_round(0, "part, ")},{lloyd_round(1, "part, ")},{lloyd_round(2, "part, ")},
o AS (SELECT row, string_agg(lower(lpad(to_hex(number), 2, '0')), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error FROM a2 GROUP BY row),
b AS (SELECT sha256(string_agg(CAST(y AS BIGINT), ',' ORDER BY part, number, k)) AS codebooks_sha256 FROM (SELECT part, number, unnest(v) AS y, generate_subscripts(v, 1) AS k FROM c2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM q JOIN o USING (row), b
"""

LEAKS = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {{words}} AS w FROM documents), i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {{words}} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, t, array_to_string(w[s + 1 : s + t], ' ') AS words FROM (SELECT item, w, least(len(w), 10) AS t, unnest(range(len(w) - least(len(w), 10) + 1)) AS s FROM i WHERE len(w) > 0)),
stretches AS (
  SELECT row, t, s, array_to_string(w[s + 1 : s + t], ' ') AS words FROM (SELECT row, w, t, unnest(range(len(w) - t + 1)) AS s FROM d, (SELECT DISTINCT t FROM windows) WHERE len(w) >= t)),
met AS (SELECT row, t, s, item FROM stretches JOIN windows USING (t, words)),
hit AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(s, s + t)) AS k FROM met) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT row, item FROM met) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN items USING (row)
""".format(words=rf"list_filter(string_split_regex({ASCII_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')")

CLUSTERS = f"""
WITH x AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {KEPT} AND len(embedding) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY place NULLS LAST, v) - 1 AS number, v FROM (SELECT sha256('1:' || vec_id) AS place, v FROM x ORDER BY place NULLS LAST, v LIMIT 16)),{lloyd_round(0)},{lloyd_round(1)},{lloyd_round(2)},{lloyd_round(3)},
names AS (SELECT number, sha256(string_agg(CAST(y AS BIGINT), ',' ORDER BY k)) AS centroid_sha256 FROM (SELECT number, unnest(v) AS y, generate_subscripts(v, 1) AS k FROM c3) GROUP BY number)
SELECT vec_id, CAST(number AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY number) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM x JOIN a3 USING (row) JOIN names USING (number)
"""

SQL: dict[str, str] = {"op2_exact_top_k": TOP_K, "op3_quality_rules": QUALITY, "op4_url_filters": URLS, "op9_mixing_sources": MIX, "op11_vector_codes": CODES, "op12_decontamination": LEAKS, "op13_centroid_clustering": CLUSTERS}
