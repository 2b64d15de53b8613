"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if more than 1/HOT_SHARE of the counted rows hold it. At most HOT_SHARE keys are, whatever the size.
HOT_SHARE = 1000


def met(rows: DataFrame, keyed: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined (inner) with ``keyed``, which has each ``key`` once and in
    ``n`` how many rows hold it. Hot keys, at most ``HOT_SHARE`` of them, are
    broadcast, so their rows stay where they are; the others are shuffled, and
    none of them has more than 1/HOT_SHARE of the counted rows. ``n`` is
    dropped. Both frames are read twice, so they should be tables."""
    total = keyed.agg(F.sum(n)).scalar()
    is_hot = F.col(n) * HOT_SHARE > total
    hot, rest = keyed.where(is_hot).drop(n), keyed.where(~is_hot).drop(n)
    cool = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cool.join(rest, key))
