"""Joining rows with one row per group when a few groups may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of more than one in HOT of all rows are hot, so there are fewer than HOT of them.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined with groups (one row per key, with its number of rows in `size`). Hot groups are fewer
    than HOT whatever the data, so they are broadcast and their rows stay where they are; the rows of
    all others meet their group by a shuffle on the key."""
    hot = groups.where(F.col(size) * HOT > total)
    cold = groups.where(F.col(size) * HOT <= total)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(others.join(cold, keys))
