"""DuckDB SQL for operators 11 to 13, over the views of the supplied tables."""

FILTER_AUDIT = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents),
first AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
fails AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           list_filter([
               CASE WHEN len(words) < 100 THEN 'A' END,
               CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
               CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g'))) > 10 * length(t) THEN 'C' END,
               CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
               CASE WHEN doc_id > first_id THEN 'E' END], lambda f: f IS NOT NULL) AS f
    FROM d JOIN first USING (t) LEFT JOIN l USING (doc_id)),
kinds AS (
    SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, f),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
    SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, string_split(substr(filter_order, 1, step - 1), '') AS before
    FROM (SELECT DISTINCT part FROM d), orders, (SELECT unnest(range(1, 6)) AS step)),
report AS (
    SELECT part, filter_order, step, x,
           sum(CASE WHEN NOT list_contains(f, x) AND NOT list_has_any(f, before) THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN list_contains(f, x) AND NOT list_has_any(f, before) THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN list_contains(f, x) AND list_has_any(f, before) THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN f = [x] THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN list_contains(f, x) AND NOT list_has_any(f, before) THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN list_contains(f, x) AND NOT list_has_any(f, before) THEN toxic ELSE 0 END) AS toxic_lost
    FROM steps JOIN kinds USING (part) GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM report
"""


def _nearest(k: int) -> str:
    return f"""
a{k} AS (
    SELECT row, p, min_by(e, d * 64 + e) AS e, min(d) AS d
    FROM (SELECT v.row, v.p, b.e, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i]))) AS d
          FROM v JOIN b{k} b USING (p))
    GROUP BY row, p)"""


def _round(k: int) -> str:
    """The codebooks after round k + 1 from those after round k."""
    return f"""{_nearest(k)},
s{k} AS (
    SELECT p, e, i, floor(sum(v.x[i]) / count(*))::BIGINT AS x
    FROM a{k} JOIN v USING (row, p), LATERAL (SELECT unnest(range(1, len(v.x) + 1)) AS i) GROUP BY p, e, i),
b{k + 1} AS (
    SELECT b.p, b.e, coalesce(m.x, b.x) AS x
    FROM b{k} b LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS x FROM s{k} GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""


BALL_CODES = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x,
           row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (
    SELECT row, p, list_slice(x, p * (len(x) // 16) + 1, (p + 1) * (len(x) // 16)) AS x
    FROM kept, (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, row - 1 AS e, x FROM v WHERE row <= 64),{_round(0)},{_round(1)},{_nearest(2)},
coded AS (
    SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY row),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), books
"""

#: Attribute ``name`` of the tag ``tag``, double quoted, single quoted or bare.
_ATTRIBUTE = r"""coalesce(nullif(regexp_extract(tag, '(?i)\s{0}\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(tag, '(?i)\s{0}\s*=\s*''([^'']*)''', 1), ''),
                    regexp_extract(tag, '(?i)\s{0}\s*=\s*([^\s"''>]+)', 1))"""

#: Targets are absolute (http://..., //host/...) or from the host's root (/...).
URL_BLOCKS = rf"""
WITH RECURSIVE rules(verdict, host_, path_) AS (
    VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
tags AS (
    SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
aims AS (
    SELECT url, CASE WHEN lower(tag) LIKE '<link%' AND list_contains(string_split_regex(lower({_ATTRIBUTE.format('rel')}), '\s+'), 'canonical')
                     THEN {_ATTRIBUTE.format('href')}
                     WHEN lower(tag) LIKE '<meta%' AND lower({_ATTRIBUTE.format('http-equiv')}) = 'refresh'
                     THEN regexp_extract({_ATTRIBUTE.format('content')}, '(?i)url\s*=\s*(\S+)', 1) END AS aim
    FROM tags),
links AS (
    SELECT url, CASE WHEN contains(aim, '://') THEN aim
                     WHEN starts_with(aim, '//') THEN 'http:' || aim
                     WHEN starts_with(aim, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || aim END AS target
    FROM aims),
named AS (
    SELECT url, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS query
    FROM (SELECT DISTINCT url, coalesce(url, '') AS u FROM (SELECT url FROM pages UNION ALL SELECT target FROM links WHERE target IS NOT NULL))),
noded AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM named),
edges AS (
    SELECT a.node AS u, b.node AS v
    FROM links JOIN noded a ON a.url = links.url JOIN noded b ON b.url = links.target WHERE a.node <> b.node),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(node, other) AS (
    SELECT u, u FROM both_ways UNION SELECT reach.node, both_ways.v FROM reach JOIN both_ways ON both_ways.u = reach.other),
ruled AS (
    SELECT host, path, max_by(r.host_ || r.path_, length(r.host_ || r.path_) * 1000 + length(r.host_)) AS rule,
           max_by(r.verdict, length(r.host_ || r.path_) * 1000 + length(r.host_)) AS verdict
    FROM (SELECT host, path FROM noded UNION SELECT host, '/' FROM noded WHERE path = '') n
    JOIN rules r ON (n.host = r.host_ OR ends_with(n.host, '.' || r.host_)) AND starts_with(n.path, r.path_)
    GROUP BY host, path),
alias AS (
    SELECT reach.node, bool_or(coalesce(verdict = 'block', false)) AND NOT bool_or(coalesce(verdict = 'allow', false)) AS alias_block,
           count(DISTINCT other) AS n_aliases
    FROM reach JOIN (SELECT DISTINCT node, host, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM noded) n ON n.node = reach.other
    LEFT JOIN ruled USING (host, path) GROUP BY reach.node)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN alias_block THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(n_aliases, 1)::BIGINT AS n_aliases, rule IS NULL AND coalesce(alias_block, false) AS by_alias
FROM pages JOIN noded ON noded.url IS NOT DISTINCT FROM pages.url LEFT JOIN ruled USING (host, path) LEFT JOIN alias USING (node)
"""
