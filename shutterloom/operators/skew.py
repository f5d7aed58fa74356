"""Groups of any size: the rows of a large one stay where they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .ranks import numbered

#: Rows of a group that one task takes whole at most.
LARGE = 100_000


def beside(rows: DataFrame, found: DataFrame, keys: Sequence[str] = ("group_id",)) -> DataFrame:
    """rows with the columns of found, which has one row (keys, size, ...) for each group; rows of other groups go.

    Rows of one group are no more than LARGE in a task by their key: what is found of larger groups is broadcast, a row for LARGE rows at most.
    Both are read more than once, so they should be tables.
    """
    keys = list(keys)
    large = found.where(F.col("size") > LARGE)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(found.where(F.col("size") <= LARGE), keys)
    return rest.unionByName(rows.join(F.broadcast(large), keys))


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows (group_id, id) of groups of up to LARGE; those of larger groups with `pos`, the place by id in the group from 1, None if there are none.

    rows should be a table. Large groups are numbered by ranges.
    """
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("size"))
    large = written(sizes.where(F.col("size") > LARGE).select("group_id"))
    if large.isEmpty():
        return rows, None
    dealt = written(numbered(rows.join(F.broadcast(large), "group_id").select("group_id", "id"), [F.col("group_id"), F.col("id")], "at"))
    first = dealt.groupBy("group_id").agg(F.min("at").alias("first"))
    places = dealt.join(F.broadcast(first), "group_id").select("group_id", "id", (F.col("at") - F.col("first") + 1).cast("int").alias("pos"))
    return rows.join(F.broadcast(large), "group_id", "left_anti"), places


def placed(rows: DataFrame) -> DataFrame:
    """rows (group_id, id), a table, with `pos`, the place by id in the group from 1."""
    small, large = parted(rows)
    ranked = small.select("group_id", "id", F.row_number().over(Window.partitionBy("group_id").orderBy("id")).alias("pos"))
    return ranked if large is None else ranked.unionByName(large)
