"""A photo catalog derived from the driver's tables; one SQL text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PHOTOS = """
SELECT
  event_id AS id,
  CONCAT('uuid-', CAST(event_id AS STRING)) AS uuid,
  CONCAT('/shoot/u', CAST(user_id AS STRING)) AS source_folder,
  CONCAT('IMG_', CAST(event_id AS STRING), CASE event_id % 4 WHEN 0 THEN '.RAF' WHEN 1 THEN '.NEF' ELSE '.JPG' END) AS filename,
  CONCAT('/shoot/u', CAST(user_id AS STRING), '/IMG_', CAST(event_id AS STRING), CASE event_id % 4 WHEN 0 THEN '.RAF' WHEN 1 THEN '.NEF' ELSE '.JPG' END) AS file_path,
  CASE event_id % 4 WHEN 0 THEN 'RAF' WHEN 1 THEN 'NEF' ELSE 'JPG' END AS format,
  CASE event_type WHEN 'click' THEN 'X100VI' WHEN 'view' THEN 'Z6III' WHEN 'purchase' THEN 'X Half' WHEN 'signup' THEN 'Other' END AS camera,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts END AS shot_at,
  ts AS imported_at,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(14 + (event_id * 7) % 240 AS DOUBLE) END AS focal_length_mm,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE (10 + (event_id * 3) % 170) / 10.0E0 END AS aperture,
  1.0E0 / (1 + (event_id * 29) % 1000) AS shutter_speed,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(100 * (1 + (event_id * 5) % 200) AS INT) END AS iso,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Velvia' WHEN 2 THEN 'Acros' ELSE 'STANDARD' END AS film_simulation,
  CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '23mm F2' ELSE '50mm F1.8' END AS lens_model,
  CAST((event_id * 37) % 101 AS DOUBLE) AS sharpness_score,
  CAST((event_id * 53 + 17) % 101 AS DOUBLE) AS exposure_score,
  (13 * ((event_id * 37) % 101) + 7 * ((event_id * 53 + 17) % 101)) / 20.0E0 AS overall_score,
  CAST(event_id % 3 AS INT) AS face_count,
  CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END AS face_detected,
  CASE WHEN event_id % 3 > 0 THEN CAST((event_id * 41) % 90 AS DOUBLE) END AS face_sharpness_score,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 0 ELSE 1 END AS eyes_open,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST((event_id * 23) % 100 AS DOUBLE) END AS iqa_score,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(30 + (event_id * 31) % 20 AS DOUBLE) END AS aesthetic_score,
  CASE WHEN event_id % 3 > 0 THEN ((event_id * 43) % 100) / 100.0E0 END AS background_distraction_score,
  CASE event_id % 8 WHEN 0 THEN 'portrait' WHEN 1 THEN 'landscape' WHEN 2 THEN 'street' WHEN 3 THEN 'night' WHEN 4 THEN 'macro' WHEN 5 THEN 'indoor' WHEN 6 THEN 'action' ELSE 'water' END AS scene,
  CASE WHEN event_id % 50 = 0 THEN 'pending' ELSE 'done' END AS analysis_status,
  CAST(value AS DOUBLE) AS value
FROM {events}"""

DECISIONS = "SELECT event_id AS image_id, CASE event_id % 7 WHEN 0 THEN 'keep' WHEN 1 THEN 'maybe' ELSE 'reject' END AS decision, ts AS decided_at FROM {events} WHERE event_id % 7 < 3"

COMPARISONS = "SELECT event_id AS winner_id, event_id - 1 AS loser_id, ts AS decided_at FROM {events} WHERE event_id % 6 = 1"

VECTORS = """
SELECT vec_id AS id, embedding, label,
  TIMESTAMP '2024-01-01 00:00:00' + CAST(FLOOR(vec_id / 20) * 600 + (vec_id % 20) * 7 AS INT) * INTERVAL '1' SECOND AS shot_at
FROM {embeddings}"""


#: Settings for measures of frames: batches of few rows, as frames and their histograms are large.
FRAMES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}


def _view(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet")})


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", PHOTOS)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", DECISIONS)


def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", COMPARISONS)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "embeddings", VECTORS)


def shooting_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos(spark, sf_dir).withColumnRenamed("uuid", "sample_uuid")


def vector_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the scores of the photos of the same ids."""
    scores = photos(spark, sf_dir).drop("shot_at")
    return vectors(spark, sf_dir).drop("label").join(scores, "id")


def second_text(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def with_views(sql: str) -> str:
    """sql with the views that it may name put before it, for DuckDB."""
    views = {"photos": PHOTOS, "decisions": DECISIONS, "comparisons": COMPARISONS, "vectors": VECTORS}
    used = [f"{name} AS ({text.format(events='events', embeddings='embeddings').strip()})" for name, text in views.items()]
    rest = sql.strip()
    start = "WITH RECURSIVE " if rest.startswith("WITH RECURSIVE ") else "WITH "
    return start + ", ".join(used) + (", " + rest[len(start) :] if rest.startswith("WITH ") else " " + rest)
