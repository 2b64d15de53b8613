"""Structured Streaming capture of posts from a landing directory."""

from postlens.streaming.capture import (
    DEFAULT_LANGS,
    DEFAULT_WORDS,
    capture_filter,
    capture_stream,
    parse_count_arg,
    parse_list_arg,
    read_captured,
    start_capture,
)

__all__ = [
    "DEFAULT_LANGS",
    "DEFAULT_WORDS",
    "capture_filter",
    "capture_stream",
    "parse_count_arg",
    "parse_list_arg",
    "read_captured",
    "start_capture",
]
