"""Explicit schemas.

Posts are read under a fixed schema instead of being inferred: inference costs
an extra pass over the input and breaks when no post in a batch carries a tag
(the array would then infer as ``array<string>``).
"""

from __future__ import annotations

from pyspark.sql import types as T

HASHTAG = T.StructType([T.StructField("text", T.StringType())])
URL = T.StructType([T.StructField("expanded_url", T.StringType())])

POST = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("favorite_count", T.LongType()),
        T.StructField(
            "entities",
            T.StructType(
                [
                    T.StructField("hashtags", T.ArrayType(HASHTAG)),
                    T.StructField("urls", T.ArrayType(URL)),
                ]
            ),
        ),
        T.StructField(
            "user",
            T.StructType(
                [
                    T.StructField("followers_count", T.LongType()),
                    T.StructField("statuses_count", T.LongType()),
                ]
            ),
        ),
    ]
)

# Header-less labelled corpus: polarity, id, date, query, user, status.
TRAINING = T.StructType(
    [
        T.StructField("polarity", T.IntegerType()),
        T.StructField("id", T.LongType()),
        T.StructField("date", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)
