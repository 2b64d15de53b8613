"""Column-level building blocks (all native Spark expressions)."""

from postlens.functions.sentiment import (
    default_draw,
    jittered_label,
    polarity_label,
    polarity_sign,
)
from postlens.functions.text import (
    alnum_list,
    clean_text,
    created_ts,
    link_list,
    link_tokens,
    mentions_any,
    minute_of_hour,
    not_blank,
    tag_list,
    tokens,
    truncate,
    whole_word_pattern,
    word_tokens,
)

__all__ = [
    "alnum_list",
    "clean_text",
    "created_ts",
    "default_draw",
    "jittered_label",
    "link_list",
    "link_tokens",
    "mentions_any",
    "minute_of_hour",
    "not_blank",
    "polarity_label",
    "polarity_sign",
    "tag_list",
    "tokens",
    "truncate",
    "whole_word_pattern",
    "word_tokens",
]
