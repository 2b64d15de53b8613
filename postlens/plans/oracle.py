"""DuckDB SQL for every checked query, over the supplied tables.

These strings are the independent reference the Spark queries are compared
with: the same post binding, the same text rules (written as split-and-filter
rather than the engine's whole-run extraction) and a closed-form Naive Bayes
(class priors and smoothed log term frequencies over 2^20 features). Terms
are keyed by their MurmurHash3 bucket, computed in SQL, so words sharing a
bucket are pooled exactly as in the hashed model.
"""

from __future__ import annotations

# --- fixed values, written out here so that an error in the engine's own shows ---
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma
mightn mustn needn shan shouldn wasn weren won wouldn
""".split()
CLEAN_UP = [
    r"\n", r"rt\s+", r"\s+@\w+", r"@\w+", r"\s+#\w+", r"#\w+",
    r"(?:https?|http?)://[\w/%.-]+", r"(?:https?|http?)://[\w/%.-]+\s+",
    r"(?:https?|http?)//[\w/%.-]+\s+", r"(?:https?|http?)//[\w/%.-]+",
]
GATE = r"^\s*[A-Za-z0-9]+(?:\s+[A-Za-z0-9]+)*\s*$"
LINK = r"(www|http)\S+"
FEATURES, SMOOTHING = 1048576, 1.0
CAPTURE_LANGS = "en fr es it pl".split()
CAPTURE_WORDS = "i et en avoir le de que no a la come io che lui era nie to w na co jest".split()
UNICODE_LANGS, UNICODE_WORDS = ["fr", "es"], ["é", "ó", "ñ", "où", "él"]
# ---------------------------------------------------------------------------------


def _lit_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


POSTS = """
posts AS (
  SELECT d.doc_id AS id, d.text, d.lang, d.n_chars AS followers, u.n AS statuses,
         strftime(e.ts, '%a %b %d %H:%M:%S +0000 %Y') AS created_at,
         CASE d.doc_id % 10
           WHEN 0 THEN []::VARCHAR[]
           WHEN 1 THEN [e.event_type, 'src_' || d.source]
           ELSE [e.event_type, upper(d.lang)] END AS hashtags,
         CASE WHEN p.url IS NULL THEN []::VARCHAR[] ELSE [p.url] END AS urls
  FROM documents d
  JOIN events e ON d.doc_id = e.event_id
  JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u ON u.user_id = e.user_id
  LEFT JOIN pages p
    ON p.page_id = ((d.doc_id % (SELECT count(*) FROM pages))
                    * (d.doc_id % (SELECT count(*) FROM pages))) % (SELECT count(*) FROM pages)
)"""


def tokens_sql(text: str, stop: str | None = None) -> str:
    """The token rule in DuckDB; ``stop`` is a SQL list."""
    expr = f"lower({text})"
    for pattern in CLEAN_UP:
        expr = f"regexp_replace({expr}, '{pattern}', '', 'g')"
    stop = stop or _lit_list(STOP_WORDS)
    return (
        f"list_filter(regexp_split_to_array({expr}, '\\W+'), "
        f"lambda w: regexp_full_match(w, '[a-zA-Z]+') AND NOT list_contains({stop}, w))"
    )


# --- MurmurHash3 x86_32 (seed 42) in SQL: the bucket HashingTF gives a term ---
# Tokens are ASCII letters, so a character's code is its UTF-8 byte. 32-bit
# arithmetic is done in HUGEINT and masked.
_M32 = (1 << 32) - 1
_C1, _C2, _N, _F1, _F2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
_SEED = 42


def _mul(a: str, const: int) -> str:
    return f"((CAST({a} AS HUGEINT) * {const}) & {_M32})"


def _rotl(x: str, r: int) -> str:
    return f"(((({x}) << {r}) | (({x}) >> {32 - r})) & {_M32})"


def _mix_k(k: str) -> str:
    return _mul(_rotl(_mul(k, _C1), 15), _C2)


def _mix_h(h: str, k: str) -> str:
    return f"(({_rotl(f'xor({h}, {k})', 13)} * 5 + {_N}) & {_M32})"


def _byte(w: str, pos: str) -> str:
    return f"CAST(ascii(substr({w}, {pos}, 1)) AS HUGEINT)"


def buckets_sql(vocab: str) -> str:
    """CTE body mapping each word ``w`` of ``vocab`` to its hashed feature
    index ``b`` (murmur3 of the UTF-8 bytes, seed 42, modulo 2^20)."""
    w = "w"
    block = " | ".join(f"({_byte(w, f'4*i+{j + 1}')} << {8 * j})" for j in range(4))
    body = (f"list_reduce(list_transform(range(strlen({w}) // 4), lambda i: {block}), "
            f"lambda h, k: {_mix_h('h', _mix_k('k'))}, CAST({_SEED} AS HUGEINT))")
    tail = (f"list_reduce(list_transform(range(strlen({w}) % 4), lambda j: "
            f"{_byte(w, f'(strlen({w}) // 4) * 4 + j + 1')} << (8 * j)), "
            f"lambda a, x: a | x, CAST(0 AS HUGEINT))")
    h0 = f"xor(xor({body}, {_mix_k(tail)}), CAST(strlen({w}) AS HUGEINT))"
    return f"""
  SELECT w, CAST(xor(h3, h3 >> 16) & {FEATURES - 1} AS BIGINT) AS b FROM (
    SELECT w, {_mul('xor(h2, h2 >> 13)', _F2)} AS h3 FROM (
      SELECT w, {_mul('xor(h1, h1 >> 16)', _F1)} AS h2 FROM (
        SELECT w, {h0} AS h1 FROM {vocab})))"""
# ---------------------------------------------------------------------------


TAGS = "array_to_string(hashtags, ' ')"
LINKS = "array_to_string(urls, ' ')"
MINUTE = "substring(created_at, 15, 2)"
DRAW = "((id * 31 + 7) % 97 % 10)"

# Closed-form multinomial Naive Bayes over hashed features, trained on the
# labelled documents: terms are keyed by the same 2^20 buckets as the model.
NB = f"""
tok AS (SELECT doc_id AS id, coalesce({tokens_sql('text')}, []::VARCHAR[]) AS tokens FROM documents),
vocab AS (SELECT DISTINCT unnest(tokens) AS w FROM tok),
buckets AS ({buckets_sql('vocab')}),
train AS (
  SELECT t.id, CAST(l.quality AS INTEGER) AS c, t.tokens
  FROM labels l JOIN tok t ON t.id = l.doc_id WHERE l.quality IN (0, 1)),
cls AS (SELECT c, count(*) AS n_c FROM train GROUP BY c),
corpus AS (SELECT sum(n_c) AS n_docs, max(c) + 1 AS k FROM cls),
tf AS (
  SELECT c, b, count(*) AS tf
  FROM (SELECT c, unnest(tokens) AS w FROM train) JOIN buckets USING (w) GROUP BY c, b),
tot AS (SELECT c, sum(tf) AS t_c FROM tf GROUP BY c),
prior AS (
  SELECT cls.c,
         ln(cls.n_c + {SMOOTHING}) - ln(corpus.n_docs + corpus.k * {SMOOTHING}) AS pi,
         ln(coalesce(tot.t_c, 0) + {FEATURES} * {SMOOTHING}) AS lden
  FROM cls JOIN corpus ON TRUE LEFT JOIN tot ON tot.c = cls.c),
ptok AS (
  SELECT id, b, count(*) AS cnt
  FROM (SELECT id, unnest(tokens) AS w FROM tok) JOIN buckets USING (w) GROUP BY id, b),
hit AS (
  SELECT p.id, tf.c, sum(p.cnt * ln(tf.tf + {SMOOTHING})) AS s
  FROM ptok p JOIN tf ON tf.b = p.b GROUP BY p.id, tf.c),
score AS (
  SELECT t.id, pr.c, pr.pi - len(t.tokens) * pr.lden + coalesce(h.s, 0) AS sc
  FROM tok t JOIN prior pr ON TRUE LEFT JOIN hit h ON h.id = t.id AND h.c = pr.c),
pred AS (
  SELECT id, CASE c WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 2 END AS polarity
  FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY sc DESC, c ASC) AS rn FROM score)
  WHERE rn = 1),
scored AS (SELECT p.*, pr.polarity FROM posts p JOIN pred pr ON pr.id = p.id WHERE p.text <> '')"""

LABEL = """CASE polarity WHEN 0 THEN 'Negative' WHEN 2 THEN 'Neutral' WHEN 4 THEN 'Positive'
               ELSE 'Neutral' END"""
JITTERED = f"""CASE WHEN polarity = 0 AND {DRAW} <= 6 THEN 'Negative'
                    WHEN polarity = 0 AND {DRAW} >= 8 THEN 'Neutral'
                    WHEN polarity = 4 AND {DRAW} >= 8 THEN 'Neutral'
                    ELSE 'Positive' END"""
SIGN = "CASE polarity WHEN 0 THEN -1 WHEN 4 THEN 1 ELSE 0 END"

def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def _hashtag_counts() -> str:
    return _with(POSTS) + f"""
SELECT lower(t) AS tag_list, count(*) AS n
FROM (SELECT {TAGS} AS t FROM posts) WHERE t <> '' AND regexp_matches(t, '{GATE}')
GROUP BY 1"""


def _url_counts() -> str:
    return _with(POSTS) + f"""
SELECT lower(u) AS url, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(l, '{LINK}', 0)) AS u
      FROM (SELECT {LINKS} AS l FROM posts) WHERE l <> '')
GROUP BY 1"""


def _influence(key_expr: str, key: str) -> str:
    return _with(POSTS) + f"""
SELECT id, {key}, followers FROM (SELECT id, {key_expr} AS {key}, followers FROM posts)
WHERE {key} <> ''"""


def _capture(langs: list[str], words: list[str]) -> str:
    runs = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda w: w <> '')"
    return _with(POSTS) + f"""
SELECT id, lang, created_at FROM posts
WHERE list_contains({_lit_list(langs)}, lang) AND list_has_any({runs}, {_lit_list(words)})"""


def oracle_sql() -> dict[str, str]:
    top = 5
    hashtag_counts = _hashtag_counts()
    url_counts = _url_counts()
    infl_tags = _influence(TAGS, "tag_list")
    infl_urls = _influence(LINKS, "urls")
    jittered_counts = _with(POSTS, NB) + f"""
SELECT {JITTERED} AS sentiment, count(*) AS n FROM scored GROUP BY 1"""
    bubble = _with(POSTS, NB) + f"""
SELECT id, followers, statuses, {SIGN} AS sentiment, {MINUTE} AS minute
FROM scored WHERE {TAGS} <> ''"""
    timeline = _with(POSTS, NB) + f"""
SELECT id, followers, {JITTERED} AS sentiment, {MINUTE} AS minute FROM scored"""
    lang_timeline = _with(POSTS) + f"""
SELECT id, lang, followers, {MINUTE} AS minute FROM posts WHERE lang <> ''"""
    capture = _capture(CAPTURE_LANGS, CAPTURE_WORDS)
    predictions = _with(POSTS, NB) + f"""
SELECT id, polarity, {LABEL} AS sentiment FROM scored"""
    share = f"""
SELECT sentiment, n, round(n * 100.0 / sum(n) OVER (), 2) AS share,
       sentiment || '(' || substring(CAST(n * 100.0 / sum(n) OVER () AS VARCHAR), 1, 4) || '%)' AS label
FROM ({jittered_counts})"""
    lang_counts = _with(POSTS) + f"""
SELECT lower(lang) AS lang, count(*) AS n FROM posts
WHERE lang <> '' AND regexp_matches(lang, '{GATE}') GROUP BY 1"""
    used = tokens_sql("text", "[]::VARCHAR[]")
    first_n = f"""
SELECT * FROM ({capture})
ORDER BY strptime(created_at, '%a %b %d %H:%M:%S %z %Y') NULLS LAST, id LIMIT 100"""
    runs = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda w: w <> '')"
    validation = _with(POSTS, NB) + """
SELECT CAST(CAST(l.quality * 4 AS DOUBLE) AS VARCHAR) AS Actual, CAST(CAST(pr.polarity AS DOUBLE) AS VARCHAR) AS Predicted,
       count(*) AS n
FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN pred pr ON pr.id = l.doc_id GROUP BY 1, 2"""
    top_tags = f"""
SELECT * FROM ({hashtag_counts}) ORDER BY n DESC, tag_list ASC LIMIT {top}"""
    return {
        "hashtag_counts": hashtag_counts,
        "capture_stop_at_n": first_n,
        "capture_resumed": capture,
        "capture_by_language_and_day": f"""
SELECT lang, strftime(strptime(replace(created_at, ' +0000', ''), '%a %b %d %H:%M:%S %Y'), '%Y-%m-%d') AS day, count(*) AS n
FROM ({capture}) WHERE lang IN ('en', 'fr') GROUP BY 1, 2""",
        "capture_line_kinds": f"""
SELECT 'captured' AS kind, count(*) AS n_counted, count(*) AS n_kept FROM ({capture})
UNION ALL SELECT 'other', (SELECT count(*) FROM ({_with(POSTS)} SELECT id FROM posts)) - count(*), 0 FROM ({capture})
UNION ALL SELECT 'control', count(*), count(*) FROM pages
UNION ALL SELECT 'broken', count(*), count(*) FROM ({_with(POSTS)} SELECT id FROM posts WHERE lang = 'de')""",
        "capture_word_table": _with(POSTS) + f"""
SELECT id, lang, created_at
FROM posts, (SELECT list(DISTINCT w) AS tracked FROM (SELECT unnest({runs}) AS w FROM conversations) WHERE length(w) >= 9)
WHERE list_contains({_lit_list(CAPTURE_LANGS)}, lang) AND list_has_any({runs}, tracked)""",
        "published_result": f"""
SELECT 'during the write' AS seen, lang, n FROM ({lang_counts})
UNION ALL SELECT 'after the switch', lower(lang), count(*) FROM ({capture}) WHERE lang <> '' AND regexp_matches(lang, '{GATE}') GROUP BY 2""",
        "chart_then_clear": f"SELECT *, 0 AS files_left FROM ({top_tags})",
        "job_train_validate": validation,
        "job_capture": _capture(UNICODE_LANGS, UNICODE_WORDS),
        "sentiment_summary": f"""
SELECT 'share' AS chart, s.sentiment, NULL AS minute, s.n, s.share, s.label, m.max_followers
FROM ({share}) s JOIN (SELECT sentiment, max(followers) AS max_followers FROM ({timeline}) GROUP BY 1) m ON m.sentiment = s.sentiment
UNION ALL
SELECT 'timeline', sentiment, minute, count(*), NULL, NULL, max(followers) FROM ({timeline}) GROUP BY sentiment, minute""",
        "hashtag_counts_top5": top_tags,
        "hashtag_counts_per_tag": _with(POSTS) + f"""
SELECT lower(t) AS tag_list, count(*) AS n
FROM (SELECT unnest(hashtags) AS t FROM posts) WHERE t <> '' AND regexp_matches(t, '{GATE}')
GROUP BY 1""",
        "url_counts": url_counts,
        "url_counts_top5": f"""
SELECT url, n, substring(url, 1, 30) AS label
FROM ({url_counts}) ORDER BY n DESC, url ASC LIMIT {top}""",
        "influential_hashtags": infl_tags,
        "influential_hashtags_top5": f"""
SELECT id, tag_list, followers, substring(tag_list, 1, 30) AS label
FROM ({infl_tags}) ORDER BY followers DESC NULLS LAST, id ASC LIMIT {top}""",
        "influential_urls": infl_urls,
        "influential_urls_top5": f"""
SELECT id, urls, followers, substring(urls, 1, 50) AS label
FROM ({infl_urls}) ORDER BY followers DESC NULLS LAST, id ASC LIMIT {top}""",
        "text_tokens": _with(POSTS) + f"""
SELECT id, CAST(len(tk) AS BIGINT) AS n_tokens, array_to_string(tk, ' ') AS tokens
FROM (SELECT id, {tokens_sql('text')} AS tk FROM posts)""",
        "nb_predictions": predictions,
        "saved_model_predictions": predictions,
        "text_tokens_custom_stopwords": _with(POSTS) + f"""
SELECT id, CAST(len(tk) AS BIGINT) AS n_tokens, array_to_string(tk, ' ') AS tokens
FROM (SELECT id, list_filter(coalesce({used}, []::VARCHAR[]), lambda w: NOT list_contains(stop, w)) AS tk
      FROM posts, (SELECT list(DISTINCT w) AS stop FROM (SELECT unnest({used}) AS w FROM benchmark)))""",
        "training_csv_roundtrip": """
SELECT CAST(l.quality * 4 AS INTEGER) AS polarity, count(*) AS n, CAST(sum(length(d.text)) AS BIGINT) AS n_chars
FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1""",
        "validation_rows": validation,
        "nb_accuracy": _with(POSTS, NB) + """
SELECT count(*) AS n_total,
       CAST(sum(CASE WHEN CAST(l.quality AS INTEGER) * 4 = pr.polarity THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       round(sum(CASE WHEN CAST(l.quality AS INTEGER) * 4 = pr.polarity THEN 1 ELSE 0 END) * 100.0 / count(*), 2)
         AS accuracy
FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN pred pr ON pr.id = l.doc_id""",
        "sentiment_counts": _with(POSTS, NB) + f"""
SELECT {LABEL} AS sentiment, count(*) AS n FROM scored GROUP BY 1""",
        "sentiment_counts_jittered": jittered_counts,
        "sentiment_share": share,
        "dispatch_sentiment_share": share,
        "sentiment_bubble": bubble,
        "sentiment_bubble_points": f"""
SELECT id,
       CASE WHEN sentiment < 0 THEN 'Negative' WHEN sentiment > 0 THEN 'Positive' ELSE 'Neutral' END
         AS series,
       TRY_CAST(minute AS INTEGER) * 100000 AS x, statuses AS y, followers // 2 AS size
FROM ({bubble})""",
        "language_counts": lang_counts,
        "result_reread": f"SELECT lang, CAST(n AS VARCHAR) AS n FROM ({lang_counts})",
        "language_followers": _with(POSTS) + """
SELECT lang, CAST(sum(followers) AS BIGINT) AS followers FROM posts WHERE lang <> '' GROUP BY 1""",
        "languages_distinct": _with(POSTS) + """
SELECT DISTINCT lang FROM posts WHERE lang <> ''""",
        "sentiment_timeline": timeline,
        "sentiment_timeline_max": f"""
SELECT sentiment, minute, max(followers) AS max_followers FROM ({timeline}) GROUP BY 1, 2""",
        "language_timeline": lang_timeline,
        "language_timeline_max": f"""
SELECT lang, minute, max(followers) AS max_followers FROM ({lang_timeline}) GROUP BY 1, 2""",
        "capture_filter": capture,
        "capture_stream": capture,
        "capture_filter_unicode": _capture(UNICODE_LANGS, UNICODE_WORDS),
        "capture_first_n": first_n,
        "json_roundtrip": _with(POSTS) + f"""
SELECT id, lang, followers, statuses, {TAGS} AS tag_list, {LINKS} AS urls, {MINUTE} AS minute
FROM posts""",
    }
