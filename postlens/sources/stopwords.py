"""Stop words removed from post text before classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the stop-word list, in its original order (153 words) ---
STOP_WORDS_TEXT = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn
doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
"""
# ---------------------------------------------------------------------------

STOP_WORDS: tuple[str, ...] = tuple(STOP_WORDS_TEXT.split())


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """``(word)``: a user's stop-word file, one word per line, in lower case.
    It stays a table, of any length; ``classifier.featurize`` takes it so."""
    return (
        spark.read.text(path)
        .select(F.lower(F.trim(F.col("value"))).alias("word"))
        .filter(F.col("word") != "")
        .distinct()
    )
