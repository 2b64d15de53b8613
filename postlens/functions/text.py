"""Column expressions over post text, tags, links and timestamps.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so the
work stays in the JVM (no Python UDF) and Catalyst can prune and push down
around it.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.sources.stopwords import STOP_WORDS

# --- fixed values: patterns whose exact text decides the results -----------
# Whole-list gate: the joined tag list (or a language code) must consist of
# ASCII letters/digits separated by whitespace, with nothing else anywhere.
ALNUM_LIST = r"^\s*[A-Za-z0-9]+(?:\s+[A-Za-z0-9]+)*\s*$"
# A link token: starts with "www" or "http", runs to the next whitespace.
LINK_TOKEN = r"(www|http)\S+"
# Text clean-up before tokenising, applied in this order, each globally.
CLEAN_PATTERNS = (
    r"\n",
    r"rt\s+",
    r"\s+@\w+",
    r"@\w+",
    r"\s+#\w+",
    r"#\w+",
    r"(?:https?|http?)://[\w/%.-]+",
    r"(?:https?|http?)://[\w/%.-]+\s+",
    r"(?:https?|http?)//[\w/%.-]+\s+",
    r"(?:https?|http?)//[\w/%.-]+",
)
# Tokens: split on non-word runs, keep purely alphabetic pieces (the plain
# form, as the SQL oracle writes it) ...
TOKEN_SPLIT = r"\W+"
ALPHA_TOKEN = r"^[a-zA-Z]+$"
# ... which is the same as taking every whole \w-run made of letters only.
ALPHA_RUN = r"(?<!\w)[a-zA-Z]++(?!\w)"
# A character of a tracked word, in any script.
WORD_CHARS = r"[\p{L}\p{M}\p{N}_]"
# Characters 15-16 of 'Wed Oct 10 20:19:24 +0000 2018' are the minute.
MINUTE_POS, MINUTE_LEN = 15, 2
CREATED_AT_FORMAT = "MMM dd HH:mm:ss Z yyyy"  # applied after the weekday
# ---------------------------------------------------------------------------

# A word list of up to so many words becomes a constant of the plan.
FEW_WORDS = 10_000
# A list of up to so many words may be broadcast (some 100 MB at most).
MANY_WORDS = 500_000
# A token of a longer list is joined under so many keys.
LIST_SALTS = 16


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tag_list(hashtags: str | Column = "entities.hashtags.text") -> Column:
    """All tags of a post joined by one space; NULL or empty list gives ''."""
    return F.concat_ws(" ", _col(hashtags))


def link_list(urls: str | Column = "entities.urls.expanded_url") -> Column:
    """All expanded links of a post joined by one space."""
    return F.concat_ws(" ", _col(urls))


def not_blank(c: str | Column) -> Column:
    """``NOT (c = '')``; as a filter it drops both '' and NULL (3VL)."""
    return _col(c) != F.lit("")


def alnum_list(c: str | Column) -> Column:
    """True when the whole string passes the alphanumeric-list gate."""
    return _col(c).rlike(ALNUM_LIST)


def link_tokens(c: str | Column) -> Column:
    """Every ``(www|http)\\S+`` match, left to right (whole match, group 0)."""
    return F.regexp_extract_all(_col(c), F.lit(LINK_TOKEN), F.lit(0))


def minute_of_hour(created_at: str | Column = "created_at") -> Column:
    """Two-character minute slice of the post time; hours are merged."""
    return F.substring(_col(created_at), MINUTE_POS, MINUTE_LEN)


def created_ts(created_at: str | Column = "created_at") -> Column:
    """The post time as a timestamp (weekday dropped before parsing)."""
    return F.try_to_timestamp(F.substring(_col(created_at), 5, 64), F.lit(CREATED_AT_FORMAT))


# The chain of CLEAN_PATTERNS in fewer passes, with the character that a text must
# hold for the step to do anything. What a step deletes ends before a character
# that is no word character, so deleting mentions and tags together deletes what
# deleting them one after the other does; "htt", "http" and "https" are written
# as one prefix. Equality with the chain is tested on generated texts.
CLEAN_STEPS = (
    (r"rt\s+", None),
    (r"\s*@\w+", "@"),
    (r"\s*#\w+", "#"),
    (r"htt(?:ps?)?://[\w/%.-]+", "/"),
    (r"htt(?:ps?)?://[\w/%.-]+\s+", "/"),
    (r"htt(?:ps?)?//[\w/%.-]+\s+", "/"),
    (r"htt(?:ps?)?//[\w/%.-]+", "/"),
)


def clean_text(text: str | Column) -> Column:
    """Lower-case, then delete line breaks, retweet markers, mentions, tags and
    links in the fixed order.

    Deleting characters never creates a new ``@``, ``#`` or ``/``, so when the
    raw text lacks a step's character the step is skipped. The guard reads the
    raw column, so each step's input is still computed once per row; it compares
    bytes (``instr`` would count characters as it goes)."""
    raw = _col(text)
    c = F.replace(F.lower(raw), F.lit("\n"), F.lit(""))
    for anchor, steps in itertools.groupby(CLEAN_STEPS, lambda s: s[1]):
        step = c
        for pattern, _ in steps:
            step = F.regexp_replace(step, pattern, "")
        c = step if anchor is None else F.when(F.contains(raw, F.lit(anchor)), step).otherwise(c)
    return c


def tokens(text: str | Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Normalised word list of a post: the cleaned text split on runs of
    non-word characters, keeping purely alphabetic tokens that are not stop
    words. Duplicates are kept.

    Taking the whole-run alphabetic matches directly is the same as splitting
    on ``\\W+`` and then keeping ``^[a-zA-Z]+$`` tokens, with one regex pass
    less; the possessive run never backtracks."""
    stop = tuple(stop_words)
    alpha = F.regexp_extract_all(clean_text(text), F.lit(ALPHA_RUN), F.lit(0))
    return F.filter(alpha, lambda w: ~w.isin(list(stop))) if stop else alpha


def listed_tokens(pairs: DataFrame, words: DataFrame, token: str = "token", salt_by: str = "key", many: int | None = None) -> DataFrame:
    """The rows of ``pairs`` whose ``token`` is in the first column of ``words``.

    Tokens shorter or longer than all listed words go first. A list of up to
    ``many`` words (``MANY_WORDS``) is broadcast, so ``pairs`` is not shuffled. Of
    a longer one, a token may be in a third of all rows, so it is joined under
    ``LIST_SALTS`` keys, by a hash of ``salt_by``; the list, each word once, is
    repeated for them."""
    salt, many = "_pl_salt", MANY_WORDS if many is None else many
    listed = words.select(F.col(words.columns[0]).alias(token)).where(F.col(token).isNotNull()).distinct()
    length = F.length(token)
    found = listed.agg(F.count(F.lit(1)).alias("n"), F.min(length).alias("least"), F.max(length).alias("most")).first()  # one row
    pairs = pairs.where(length.between(found.least, found.most)) if found.n else pairs
    if found.n <= many:
        return pairs.join(F.broadcast(listed), token)
    listed = listed.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(LIST_SALTS - 1))))
    salted = pairs.withColumn(salt, F.pmod(F.xxhash64(salt_by), F.lit(LIST_SALTS)).cast("int"))
    return salted.join(listed, [token, salt]).drop(salt)


def without_words(df: DataFrame, tokens_col: str, words: DataFrame, few: int = FEW_WORDS) -> DataFrame:
    """``df`` with the tokens that ``words`` (its first column) holds taken out
    of the array ``tokens_col``; order and repeats of the others stay. A null
    array becomes an empty one.

    A list of up to ``few`` words becomes a constant of the plan, and nothing is
    shuffled. A longer one stays a table: the distinct tokens of each row meet
    it, only hits come back, and what is taken out is looked up by a digest of
    the row's tokens. The digest is a stable key: it does not depend on the order
    of rows, needs no unique id, and rows with equal tokens have equal hits."""
    own = words.select(F.col(words.columns[0]).alias("word")).where("word is not null").distinct()
    found = [r.word for r in own.limit(few + 1).collect()]
    tokens = F.coalesce(tokens_col, F.array().cast("array<string>"))
    if len(found) <= few:
        # one expression in SQL: a call to the JVM instead of one for each word
        listed = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in found)
        each = F.expr(f"filter(`{tokens_col}`, w -> w NOT IN ({listed}))") if found else F.col(tokens_col)
        return df.withColumn(tokens_col, F.coalesce(each, F.array().cast("array<string>")))
    digest, hits = "_pl_digest", "_pl_hits"
    keyed = df.withColumn(digest, F.md5(F.array_join(tokens, " ")))
    pairs = keyed.select(F.col(digest).alias("key"), F.explode(F.array_distinct(tokens)).alias("token"))
    # distinct tokens of one row: bounded by the row
    taken = listed_tokens(pairs, own).groupBy(F.col("key").alias(digest)).agg(F.collect_set("token").alias(hits))
    left = F.when(F.col(hits).isNull(), tokens).otherwise(F.filter(tokens, lambda w: ~F.array_contains(hits, w)))
    return keyed.join(taken, digest, "left").withColumn(tokens_col, left).select(*df.columns)


def whole_word_pattern(words: Iterable[str]) -> str:
    """A regex matching any of ``words``, in lower case, as a whole run of
    ``WORD_CHARS``. The alternation is laid out as a prefix tree so each
    position costs one branch per character, not one per word. A word with
    any other character could never match and is refused."""
    trie: dict = {}
    for word in {w.lower() for w in words}:
        if not word or any(unicodedata.category(ch)[0] not in "LMN" and ch != "_" for ch in word):
            raise ValueError(f"not a word that a text could hold: {word!r}")
        node = trie
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}
    if not trie:
        raise ValueError("no words to look for")

    def emit(node: dict) -> str:
        alts = [ch + emit(child) for ch, child in sorted(node.items()) if ch]
        if "" in node and alts:
            alts.append("")
        if not alts:
            return ""
        return alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"

    return f"(?<!{WORD_CHARS}){emit(trie)}(?!{WORD_CHARS})"


def mentions_any(text: str | Column, words: Iterable[str]) -> Column:
    """True when the lower-cased text has any of ``words`` as a whole word
    (the same test as ``arrays_overlap(word_tokens(text), words)``); stops at
    the first hit."""
    return F.lower(_col(text)).rlike(whole_word_pattern(words))


def word_tokens(text: str | Column) -> Column:
    """Lower-cased runs of ``WORD_CHARS`` (whole-word matching for capture)."""
    return F.filter(F.split(F.lower(_col(text)), "[^" + WORD_CHARS[1:] + "+"), lambda w: w != "")


def truncate(c: str | Column, n: int) -> Column:
    """First ``n`` characters of a chart label."""
    return F.substring(_col(c), 1, n)
