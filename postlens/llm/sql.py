"""DuckDB SQL for the queries that SQL can express, over the view ``documents``."""

EXACT_DEDUP = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
    FROM documents)
SELECT doc_id, text_sha256,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept
FROM d
"""

QUALITY = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || source, 'null') AS host,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
windows AS (
    SELECT doc_id, i, list_slice(words, i, i + 4) AS w
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
again AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) AS r(k) GROUP BY doc_id),
line AS (
    SELECT doc_id, host, l,
           trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS normal
    FROM (SELECT doc_id, host, unnest(lines) AS l FROM d)),
hosts AS (SELECT host, count(*) AS n_docs FROM d GROUP BY host),
frequent AS (
    SELECT host, normal
    FROM (SELECT host, normal, count(DISTINCT doc_id) AS n FROM line GROUP BY host, normal) JOIN hosts USING (host)
    WHERE n > 20 AND n > 0.1 * n_docs),
gone AS (
    SELECT doc_id, sum(len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS n
    FROM line SEMI JOIN frequent USING (host, normal) GROUP BY doc_id),
m AS (
    SELECT d.doc_id, len(words)::BIGINT AS n_words,
           length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
           coalesce(gone.n, 0)::BIGINT AS n_removed
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (n_removed > 0 AND (n_words - n_removed < 10 OR n_words - n_removed < 0.3 * n_words)) AS kept
FROM b
"""

MIXING = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce('=' || source, 'null') AS source_key,
           len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS n_tokens,
           md5(coalesce(doc_id::VARCHAR, 'null') || ':17') AS order_key
    FROM documents),
s AS (
    SELECT source_key, sum(n_tokens)::BIGINT AS n, sum(n_tokens) / (SELECT sum(n_tokens) FROM d)::DOUBLE AS share
    FROM d GROUP BY source_key HAVING sum(n_tokens) > 0),
ends AS (SELECT min(share) AS small, max(share) AS large FROM s),
bisect(step, lo, hi) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT step + 1,
           CASE WHEN pow(small, (lo + hi) / 2 - 1) / pow(large, (lo + hi) / 2 - 1) <= 1.5 THEN lo ELSE (lo + hi) / 2 END,
           CASE WHEN pow(small, (lo + hi) / 2 - 1) / pow(large, (lo + hi) / 2 - 1) <= 1.5 THEN (lo + hi) / 2 ELSE hi END
    FROM bisect, ends WHERE step < 40),
e AS (SELECT hi AS exponent FROM bisect WHERE step = 40),
p AS (SELECT source_key, n, pow(share, exponent) AS power FROM s, e),
w AS (
    SELECT source_key, n, power / (SELECT sum(power) FROM p) AS weight,
           power * (SELECT max(n / power) FROM p) AS budget
    FROM p),
plan AS (
    SELECT source_key, weight, floor(budget + 1e-6)::BIGINT AS budget, floor(budget / n + 1e-6)::BIGINT AS passes,
           greatest(0, floor(budget - floor(budget / n + 1e-6) * n + 1e-6))::BIGINT AS rest
    FROM w),
o AS (
    SELECT *, sum(n_tokens) OVER (PARTITION BY source_key ORDER BY order_key RANGE UNBOUNDED PRECEDING) AS through FROM d),
cut AS (
    SELECT source_key, min(order_key) AS last_key FROM o JOIN plan USING (source_key)
    WHERE rest > 0 AND through >= rest GROUP BY source_key)
SELECT doc_id, source_key, n_tokens, round(coalesce(weight, 0), 6) AS weight, coalesce(budget, 0) AS budget, order_key,
       coalesce(passes, 1) + CASE WHEN order_key <= last_key THEN 1 ELSE 0 END AS copies
FROM d LEFT JOIN plan USING (source_key) LEFT JOIN cut USING (source_key)
"""

ARCHIVE = r"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""

NEAR_DEDUP = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
               lambda w: w <> '') AS words
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, list_slice(words, i, i + 2) AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared
    FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT u, v FROM pairs JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v
    WHERE 100 * shared >= 85 * (nu.n + nv.n - shared)),
reach AS (
    SELECT doc_id, doc_id AS other FROM d
    UNION
    SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

SUBSTRINGS = r"""
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents),
w AS (
    SELECT doc_id, i, list_slice(words, i, i + 34) AS w
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY w) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, range(35) AS r(k)),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
    FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, len(words) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
