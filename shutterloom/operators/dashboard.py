"""Dashboard aggregates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import APERTURE_CLASSES, DECISIONS, FEATURE_SECTIONS, FEATURES, FOCAL_CLASSES, ISO_CLASSES
from ..functions.scalars import month_period, week_period
from ..functions.scores import zero
from ..storage import written
from .ranks import quantiles, refined_medians, upper_median, values_at


def since(rows: DataFrame, at: str, start: str | None) -> DataFrame:
    """rows from a date on."""
    return rows if start is None else rows.where(F.col(at) >= F.lit(start).cast("timestamp"))


def shooting_cameras(log: DataFrame, start: str | None = None) -> DataFrame:
    """A1."""
    return since(log, "shot_at", start).where("camera is not null").groupBy("camera").agg(F.count("*").alias("count"), F.max("shot_at").alias("last_shot"))


def class_of(value: Column, classes: tuple) -> tuple[Column, Column]:
    """Label and place of the value's class; null is "Unknown", after all others."""
    label, place = F.when(value.isNull(), "Unknown"), F.when(value.isNull(), len(classes))
    for n, (below, name) in enumerate(classes):
        if below is None:
            return label.otherwise(name), place.otherwise(n)
        label, place = label.when(value < below, name), place.when(value < below, n)
    return label, place


def distribution(log: DataFrame, column: str, classes: tuple, start: str | None = None) -> DataFrame:
    """(bucket, place, count) of the classes that occur."""
    label, place = class_of(F.col(column), classes)
    return since(log, "shot_at", start).groupBy(label.alias("bucket"), place.alias("place")).agg(F.count("*").alias("count"))


#: A2, A3, A4.
focal_distribution = functools.partial(distribution, column="focal_length_mm", classes=FOCAL_CLASSES)
aperture_distribution = functools.partial(distribution, column="aperture", classes=APERTURE_CLASSES)
iso_distribution = functools.partial(distribution, column="iso", classes=ISO_CLASSES)


def named_distribution(log: DataFrame, column: str, start: str | None = None) -> DataFrame:
    """Films or lenses, null as "Unknown"."""
    return since(log, "shot_at", start).groupBy(F.coalesce(F.col(column), F.lit("Unknown")).alias(column)).agg(F.count("*").alias("count"))


def period(at: Column, bucket: str) -> Column:
    """The week or month of a time; any other bucket is an error."""
    if bucket not in ("week", "month"):
        raise ValueError(f"bucket is week or month: {bucket}")
    return week_period(at) if bucket == "week" else month_period(at)


def shooting_timeline(log: DataFrame, bucket: str = "week", start: str | None = None) -> DataFrame:
    """A7."""
    return since(log, "shot_at", start).where("shot_at is not null").groupBy(period(F.col("shot_at"), bucket).alias("period")).agg(F.count("*").alias("count"))


def _counts(column: Column, values: tuple[str, ...]) -> list[Column]:
    return [F.count_if(column == v).alias(v) for v in values]


def decisions_timeline(decided: DataFrame, bucket: str = "week", start: str | None = None) -> DataFrame:
    """Keep, maybe and reject by period; periods without decisions are absent."""
    rows = since(decided, "decided_at", start).where("decided_at is not null")
    return rows.groupBy(period(F.col("decided_at"), bucket).alias("period")).agg(*_counts(F.col("decision"), DECISIONS))


def feature_deltas(samples: DataFrame, start: str | None = None, at: str = "decided_at") -> DataFrame:
    """Median and number of each feature among kept and among rejected samples, for all features.

    samples (decision, features_json). Malformed JSON is skipped, null and NaN values too. The texts are read once, into a table of
    a column for each feature; exact medians of all features come from a few scans of it that count, and no value is shuffled.
    """
    values = F.from_json("features_json", "map<string,double>")
    # Without a condition on the map, which would read each text once more; a text that is no JSON has no value for any feature.
    rows = since(samples, at, start).where(F.col("decision").isin("keep", "reject")).select("decision", values.alias("m"))
    flat = written(rows.select("decision", *(F.col("m")[f].cast("float").alias(f) for f in FEATURES)))
    found = refined_medians(flat, FEATURES, "decision", ("keep", "reject"))
    listed = [(f, *(found[f, d][1] for d in ("keep", "reject")), *(found[f, d][0] for d in ("keep", "reject"))) for f in FEATURES]
    return samples.sparkSession.createDataFrame(listed, "feature string, keep_median double, reject_median double, keep_n bigint, reject_n bigint")


def signal_flags(deltas: DataFrame) -> DataFrame:
    """A10: weak where a median is missing, the difference is small or both are about 0; low_sample below 5; and the section."""
    keep, reject = F.col("keep_median"), F.col("reject_median")
    weak = keep.isNull() | reject.isNull() | (F.abs(keep - reject) < 0.01) | ((F.abs(keep) < 0.01) & (F.abs(reject) < 0.01))
    section = F.lit("other")
    for name, features in FEATURE_SECTIONS.items():
        section = F.when(F.col("feature").isin(*features), name).otherwise(section)
    return deltas.withColumns({"delta": keep - reject, "weak": weak, "low_sample": F.least("keep_n", "reject_n") < 5, "section": section})


def decision_totals(timeline: DataFrame) -> DataFrame:
    """Totals, the busiest period (the first of equals) and the share kept."""
    n = F.col("keep") + F.col("maybe") + F.col("reject")
    # Of equal counts the earlier period: max_by takes the largest, so the period's order is turned.
    sums = timeline.agg(*(F.sum(d).alias(d) for d in DECISIONS), F.sum(n).alias("total"), F.max(n).alias("busiest_count"))
    busiest = timeline.withColumn("n", n).orderBy(F.desc("n"), "period").limit(1).select(F.col("period").alias("busiest"))
    return sums.join(busiest, F.lit(True), "left").withColumn("keep_rate", F.when(F.col("total") > 0, F.round(F.col("keep") / F.col("total"), 4)).otherwise(F.lit(0.0)))


def folders(images: DataFrame) -> DataFrame:
    """A12."""
    return images.where("source_folder is not null").groupBy("source_folder").agg(F.count("*").alias("count"), F.max("imported_at").alias("last_import"))


def decision_counts(images: DataFrame, decided: DataFrame) -> DataFrame:
    """Undecided ones are those that are done."""
    rows = images.select("id", "analysis_status").join(decided.select(F.col("image_id").alias("id"), "decision"), "id", "left")
    return rows.agg(F.count("*").alias("all"), F.count_if(F.col("decision").isNull() & (F.col("analysis_status") == "done")).alias("undecided"), *_counts(F.col("decision"), DECISIONS))


def session_stats(images: DataFrame, decided: DataFrame) -> DataFrame:
    """Mean score of kept photos, faces, cameras, upper median score and the best photo.

    The upper median is the value at floor(n/2) in order.
    """
    rows = images.join(decided.select(F.col("image_id").alias("id"), "decision"), "id", "left")
    stats = rows.agg(
        F.round(F.avg(F.when(F.col("decision") == "keep", F.col("overall_score"))), 4).alias("kept_average"),
        F.sum(zero(F.col("face_count"))).alias("faces"),
        F.count_distinct("camera").alias("cameras"),
        F.max(F.struct("overall_score", (-F.col("id")).alias("turned"))).alias("top"),
    )
    median = values_at(images, "overall_score", {"upper_median": upper_median})
    return stats.join(median, F.lit(True), "left").select("kept_average", "faces", "cameras", "upper_median", (-F.col("top.turned")).alias("top_image"), F.col("top.overall_score").alias("top_score"))


def camera_list(images: DataFrame) -> DataFrame:
    """A15."""
    return images.where("camera is not null").groupBy("camera").agg(F.max(F.to_date("shot_at")).alias("newest"))


def group_composition(members: DataFrame, images: DataFrame, decided: DataFrame) -> DataFrame:
    """Members (group_id, id)."""
    raw = F.upper(F.col("format")).isin("RAF", "NEF")
    rows = members.select("group_id", "id").join(images.select("id", "format"), "id").join(decided.select(F.col("image_id").alias("id"), "decision"), "id", "left")
    sums = rows.groupBy("group_id").agg(F.count("*").alias("size"), *_counts(F.col("decision"), DECISIONS), F.count("decision").alias("decided"), F.bool_or(raw).alias("any_raw"), F.bool_or(~raw).alias("any_rendered"), F.min("decision").alias("low"), F.max("decision").alias("high"))
    return sums.select("group_id", "size", *DECISIONS, "decided", (F.col("decided") == F.col("size")).alias("all_decided"), F.when((F.col("decided") == F.col("size")) & (F.col("low") == F.col("high")), F.col("low")).alias("unanimous"), (F.col("any_raw") & F.col("any_rendered")).alias("mixed"))


def sharpness_summary(scores: DataFrame, column: str = "sharpness_score", sharp: float = 70) -> DataFrame:
    """A17."""
    x = F.col(column)
    n = F.count(x)
    share = lambda c: F.round(100 * F.count_if(c) / n, 2)
    stats = scores.agg(n.alias("n"), F.count_if(x >= sharp).alias("sharp"), F.count_if(x < 40).alias("blurry"), share(x >= sharp).alias("sharp_pct"), share(x < 40).alias("blurry_pct"), F.round(F.avg(x), 4).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.stddev_pop(x), 4).alias("std"))
    return stats.join(quantiles(scores, column, {"median": 0.5}).drop("total"), F.lit(True), "left")


def calibrate_sharpness(scores: DataFrame, column: str = "sharpness_score", current: float = 40.0) -> DataFrame:
    """Quantiles, the suggested floor (0.8 of the 5th) and how many either floor rejects."""
    x = F.col(column)
    stats = scores.agg(F.min(x).alias("min"), F.round(F.avg(x), 4).alias("mean"), F.max(x).alias("max"))
    stats = stats.join(quantiles(scores, column, {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75}).drop("total"), F.lit(True), "left")
    stats = stats.withColumn("suggested", F.bround(F.col("p5") * 0.8, 1))
    # One row of statistics against the scores: the only side that is broadcast has one row.
    rejects = scores.select(x.alias("x")).join(F.broadcast(stats.select("suggested")), F.lit(True)).agg(F.count_if(F.col("x") < current).alias("rejects_now"), F.count_if(F.col("x") < F.col("suggested")).alias("rejects_suggested"))
    return stats.join(rejects, F.lit(True))


def pending_reanalysis(images: DataFrame) -> DataFrame:
    """A20."""
    return images.agg(F.count_if((F.col("face_detected") == 1) & (F.col("analysis_status") == "done") & F.col("face_embedding").isNull()).alias("pending"))


def pairwise_tallies(comparisons: DataFrame) -> DataFrame:
    """Wins, losses and the latest comparison of each photo."""
    sides = F.explode(F.array(F.struct(F.col("winner_id").alias("id"), F.lit(1).alias("won")), F.struct(F.col("loser_id").alias("id"), F.lit(0).alias("won"))))
    rows = comparisons.select("decided_at", sides.alias("x"))
    return rows.groupBy("x.id").agg(F.sum("x.won").cast("long").alias("wins"), F.sum(1 - F.col("x.won")).cast("long").alias("losses"), F.max("decided_at").alias("last_decided"))


def learned_signals(importances: DataFrame, floor: float = 0.05) -> DataFrame:
    """(feature, importance) with those below the floor pooled as "other"."""
    return importances.groupBy(F.when(F.col("importance") >= floor, F.col("feature")).otherwise("other").alias("feature")).agg(F.round(F.sum("importance"), 6).alias("importance"))


def model_card(samples: DataFrame, trained: int, beats_baseline: bool) -> DataFrame:
    """A24."""
    n = F.count("*")
    status = F.when(n < 50, "learning").when(F.lit(beats_baseline), "ready").otherwise("underperforming")
    return samples.agg(n.alias("decided"), F.greatest(F.lit(0), n - trained).alias("pending"), status.alias("status"))
