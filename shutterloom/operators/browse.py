"""Filters, sorts, catalog views and search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SORT_FIELDS
from ..functions.scores import zero


def between_dates(at: Column, first: str, last: str | None = None) -> Column:
    """both days included; null fails; `last` defaults to `first`."""
    return F.coalesce(F.to_date(at).between(F.lit(first).cast("date"), F.lit(last or first).cast("date")), F.lit(False))


def subject(kind: str) -> Column:
    """portraits, landscape or group; an unknown number of faces is 0."""
    n = zero(F.col("face_count"))
    return {"portraits": n >= 1, "landscape": n == 0, "group": n > 1}[kind]


def decided_as(kind: str) -> Column:
    """F4 on rows with decision and analysis_status: a decision, or "undecided"."""
    return F.col("decision").isNull() & (F.col("analysis_status") == "done") if kind == "undecided" else F.col("decision") == kind


def name_contains(text: str) -> Column:
    """F5."""
    return F.lower("filename").contains(text.lower())


def matching_groups(members: DataFrame, condition: Column) -> DataFrame:
    """(group_id, matching_count, total) of groups with a member for which the condition holds."""
    return members.groupBy("group_id").agg(F.count_if(condition).alias("matching_count"), F.count("*").alias("total")).where("matching_count > 0")


def histogram_backlog(images: DataFrame) -> DataFrame:
    """F8."""
    return images.where("histogram_json is null and preview_path is not null")


def catalog(images: DataFrame, decided: DataFrame, folder: str | None = None) -> DataFrame:
    """Images with their decision, newest import first."""
    rows = images if folder is None else images.where(F.col("source_folder") == folder)
    return rows.join(decided.select(F.col("image_id").alias("id"), "decision", "decided_at"), "id", "left").orderBy(F.desc("imported_at"), F.desc("id"))


def photo_order(field: str = "shot_at", descending: bool = True) -> list[Column]:
    """O1: nulls last in both directions, equals by id."""
    if field not in SORT_FIELDS:
        raise ValueError(f"no such field: {field}")
    return [F.desc_nulls_last(field) if descending else F.asc_nulls_last(field), F.asc("id")]


def rank_groups(groups: DataFrame, places: DataFrame) -> DataFrame:
    """O3: groups (group_id, hero) in order of the hero's place on the grid, missing ones last."""
    return groups.join(places.select(F.col("id").alias("hero"), "place"), "hero", "left").orderBy(F.asc_nulls_last("place"), "group_id")


def dot_matrix(vectors: Sequence[Sequence[float]]):
    """Function of an embedding column: array of its dot products with each of the few vectors; null for null."""
    matrix = np.asarray(vectors, np.float64)

    def dots(embedding: pa.Array) -> pa.Array:
        known = embedding.drop_null()
        n = len(known)
        scores = np.asarray(known.flatten(), np.float64).reshape(n, -1) @ matrix.T if n else np.empty((0, len(matrix)))
        rows = iter(scores.tolist())
        return pa.array([next(rows) if x else None for x in embedding.is_valid().to_pylist()], pa.list_(pa.float64()))

    return F.arrow_udf(dots, "array<double>")


def tag_scene(photos: DataFrame, labels: dict[str, Sequence[float]]) -> DataFrame:
    """Photos with scene and scene_confidence: the label whose vector is nearest, the first of equals."""
    scores = photos.withColumn("__dots", dot_matrix(list(labels.values()))(F.col("embedding")))
    best = F.array_max("__dots")
    name = F.element_at(F.array(*map(F.lit, labels)), F.array_position("__dots", best).cast("int"))
    return scores.withColumns({"scene": F.when(best.isNotNull(), name), "scene_confidence": F.when(best.isNotNull(), F.greatest(F.lit(0.0), F.bround(best, 4)))}).drop("__dots")


def concept_axes(photos: DataFrame, prompts: dict[str, tuple[Sequence[float], Sequence[float]]], face_only: tuple[str, ...] = ("eye_contact_score",)) -> DataFrame:
    """Photos with a column for each axis: the logistic of the difference to its two prompts, over 0.05."""
    vectors = [v for pair in prompts.values() for v in pair]
    rows = photos.withColumn("__dots", dot_matrix(vectors)(F.col("embedding")))
    for n, axis in enumerate(prompts):
        value = F.bround(1 / (1 + F.exp((F.col("__dots")[2 * n + 1] - F.col("__dots")[2 * n]) / 0.05)), 4)
        rows = rows.withColumn(axis, F.when(zero(F.col("face_detected")) == 1, value) if axis in face_only else value)
    return rows.drop("__dots")


def semantic_search(photos: DataFrame, query: Sequence[float], limit: int = 50, threshold: float = 0.20) -> DataFrame:
    """O2: (id, score) of the photos nearest to the query, best first: the top k of each task meet, not all rows."""
    limit, threshold = min(500, max(1, limit)), min(1.0, max(0.0, threshold))
    scored = photos.where("embedding is not null").select("id", dot_matrix([query])("embedding")[0].alias("raw"))
    return scored.where(F.col("raw") >= threshold).orderBy(F.desc("raw"), "id").limit(limit).select("id", F.bround("raw", 4).alias("score"))


def search_groups(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """Hits in groups are one row with the best-scoring member, others stay."""
    rows = hits.join(groups.select("id", "group_id"), "id", "left")
    return rows.groupBy("group_id", F.when(F.col("group_id").isNull(), F.col("id")).alias("single")).agg(F.max("score").alias("score"), F.max_by("id", F.struct("score", (-F.col("id")).alias("i"))).alias("best_id")).drop("single")
