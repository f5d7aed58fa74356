"""Bursts and time segments (G1, G2, A19) without a window over all rows.

Photos are cut where the gap to the one before is too long. The order is global, so hours are
sorted each for itself; what an hour hands to the next (its last time, how many runs it started)
is one row an hour, and only those rows meet in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import burst_score
from ..storage import written
from .skew import beside


def time_runs(photos: DataFrame, gap: float, at: str = "shot_at", by: tuple[str, ...] = ()) -> DataFrame:
    """photos with a non-null time and `run`: 1, 2, ... in order of time, anew in each group of `by` (none: over all).

    A photo starts a run if it is more than `gap` seconds, 0 or more, after the one before.
    """
    second = F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000
    rows = photos.where(F.col(at).isNotNull()).withColumn("__t", second)
    # Photos of one time are in one run, so windows see each time once: an hour that cameras without a clock share is a few rows.
    times = rows.select(*by, "__t").distinct().withColumn("__hour", F.floor(F.col("__t") / 3600))
    inside = Window.partitionBy(*by, "__hour").orderBy("__t")
    times = times.withColumn("__before", F.lag("__t").over(inside))
    # How an hour's first photo relates to the hour before is settled from one row an hour.
    starts = (F.col("__t") - F.col("__before") > gap).cast("int")
    times = times.withColumn("__in_hour", F.sum(F.coalesce(starts, F.lit(0))).over(inside))
    hours = times.groupBy(*by, "__hour").agg(F.min("__t").alias("first"), F.max("__t").alias("last"), F.max("__in_hour").alias("more"))
    order = Window.partitionBy(*by).orderBy("__hour")
    opens = F.coalesce((F.col("first") - F.lag("last").over(order) > gap).cast("int"), F.lit(1))
    hours = hours.withColumn("opens", opens)
    base = F.sum("opens").over(order) + F.coalesce(F.sum("more").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.withColumn("base", base).select(*(F.col(c).alias(f"__{n}") for n, c in enumerate(by)), F.col("__hour").alias("__h"), "base")
    numbered = _met(times, hours, by, times["__hour"] == hours["__h"]).select(*(F.col(c).alias(f"__by{n}") for n, c in enumerate(by)), F.col("__t").alias("__at"), (F.col("base") + F.col("__in_hour")).alias("run"))
    condition = rows["__t"] == numbered["__at"]
    for n, c in enumerate(by):
        condition &= rows[c].eqNullSafe(numbered[f"__by{n}"])
    return rows.join(numbered, condition).select(*photos.columns, "run")


def _met(rows: DataFrame, other: DataFrame, by: tuple[str, ...], condition) -> DataFrame:
    """rows joined with other, whose columns __0, __1, ... stand for `by`."""
    for n, c in enumerate(by):
        condition &= rows[c].eqNullSafe(other[f"__{n}"])
    return rows.join(other, condition)


def detect_bursts(photos: DataFrame, gap: float = 2.0, by: tuple[str, ...] = ()) -> DataFrame:
    """G1: (id, burst_id, role, score, size, duration) of every photo.

    Runs of two photos or more are bursts, numbered from 1 in order of time; the best score is the hero,
    the first of equals in order of time. Photos alone or without a time are single, with a null burst_id.
    """
    shake = F.col("shake_score") if "shake_score" in photos.columns else None
    scored = photos.withColumn("score", burst_score(F.col("sharpness_score"), F.col("exposure_score"), shake))
    runs = written(time_runs(scored.select("id", "shot_at", "score", *by), gap, by=by))
    second = F.unix_micros(F.col("shot_at").cast("timestamp")) / 1_000_000
    sums = runs.groupBy(*by, "run").agg(F.count("*").alias("size"), (F.max(second) - F.min(second)).alias("duration"), F.max_by("id", F.struct("score", (-second).alias("t"), (-F.col("id")).alias("i"))).alias("hero")).where("size > 1")
    # Bursts are numbered with one row a run; runs come in blocks so that no task sorts them all.
    numbered = written(_dense(sums, by))
    grouped = beside(runs, numbered, [*by, "run"])
    single = scored.select("id", "score").join(grouped.select("id", "burst_id", "hero", "size", "duration"), "id", "left")
    role = F.when(F.col("burst_id").isNull(), "single").when(F.col("id") == F.col("hero"), "hero").otherwise("burst_alternative")
    return single.select("id", "burst_id", role.alias("role"), F.bround("score", 1).alias("score"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), F.coalesce("duration", F.lit(0.0)).alias("duration"))


def _dense(runs: DataFrame, by: tuple[str, ...], block: int = 100_000) -> DataFrame:
    """runs with burst_id: 1, 2, ... in order of `run`."""
    rows = runs.withColumn("__block", F.floor(F.col("run") / block))
    inside = F.row_number().over(Window.partitionBy(*by, "__block").orderBy("run"))
    sizes = rows.groupBy(*by, "__block").agg(F.count("*").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__ahead", ahead).drop("__n")
    return rows.withColumn("__at", inside).join(sizes, [*by, "__block"]).withColumn("burst_id", F.col("__ahead") + F.col("__at")).drop("__block", "__at", "__ahead")


def burst_summary(bursts: DataFrame) -> DataFrame:
    """A19."""
    grouped = F.col("burst_id").isNotNull()
    sums = bursts.agg(F.count("*").alias("total"), F.count_if(F.col("role") == "hero").alias("groups"), F.count_if(grouped).alias("burst_photos"), F.count_if(~grouped).alias("singles"))
    redundant = F.col("burst_photos") - F.col("groups")
    return sums.select("*", redundant.alias("redundant"), F.when(F.col("total") > 0, F.round(100 * redundant / F.col("total"), 1)).otherwise(F.lit(0.0)).alias("reduction_pct"))


def time_segments(photos: DataFrame, gap: float = 60.0) -> DataFrame:
    """Photos with segment: the run of `gap`, and 0 for all photos without a time."""
    timed = time_runs(photos, gap).withColumnRenamed("run", "segment")
    untimed = photos.where("shot_at is null").withColumn("segment", F.lit(0).cast("long"))
    return timed.unionByName(untimed)
