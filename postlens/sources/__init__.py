"""Sources: posts (JSON lines), labelled corpus (CSV), stop words, test tables."""

from postlens.sources.posts import parse_posts, posts_to_json, read_posts, read_result
from postlens.sources.stopwords import STOP_WORDS, read_stop_words
from postlens.sources.testdata import posts_from_testdata, table, training_from_testdata
from postlens.sources.training import read_training_csv

__all__ = [
    "STOP_WORDS",
    "parse_posts",
    "posts_from_testdata",
    "posts_to_json",
    "read_posts",
    "read_result",
    "read_stop_words",
    "read_training_csv",
    "table",
    "training_from_testdata",
]
