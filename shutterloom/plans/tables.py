"""Queries on keeping the catalog's tables, and live jobs run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..storage import written
from ..sources import buckets, catalog
from ..sources.buckets import BucketTable
from ..streaming import watch
from . import views


def _half(photos):
    """Photos of even ids: what the catalog has already, with other uuids for every third."""
    return photos.where("id % 2 = 0").withColumn("uuid", F.when(F.col("id") % 3 > 0, F.concat(F.lit("old-"), "id")))


def s3_skip_done(spark, sf_dir):
    photos = views.photos(spark, sf_dir)
    return catalog.skip_done(photos.select("id", F.col("file_path").alias("path")), _half(photos)).select("id", "path")


def _table(rows, key, buckets=16):
    """rows as a table in buckets."""
    table = BucketTable(rows.sparkSession, f"{_shared(rows.sparkSession)}/table-{uuid.uuid4().hex}", rows.schema, key, buckets)
    table.create(rows)
    return table


def s4_unfinished(spark, sf_dir):
    """Photos of all users below one root, every fifth in a decision folder; the even ones are in the catalog, of these every third under a folder of its own."""
    photos = views.photos(spark, sf_dir).withColumn("file_path", F.concat("source_folder", F.when(F.col("id") % 5 == 0, "/_Keeps/").otherwise("/"), "filename"))
    images = _half(photos).withColumn("source_folder", F.when(F.col("id") % 3 > 0, "/shoot").otherwise(F.col("source_folder")))
    return catalog.unfinished(photos.select(F.col("file_path").alias("path")), images, "/shoot/")


def s5_removed(spark, sf_dir):
    photos = views.photos(spark, sf_dir)
    files = photos.where("id % 4 > 0").select(F.col("file_path").alias("path"))
    return catalog.sync_missing(photos, files, "/shoot/u7")[1].select("id", "file_path")


def s6_upsert_images(spark, sf_dir):
    """A batch of every third photo, re-analysed with a sharpness one higher, put into the table of the half, twice under one id."""
    photos = views.photos(spark, sf_dir)
    batch = photos.where("id % 3 = 0").withColumn("sharpness_score", F.col("sharpness_score") + 1).withColumn("source_folder", F.lit("/new"))
    table = _table(_half(photos), "file_path")
    for _ in range(2):
        buckets.put_images(table, batch, "analysis", 1)
    return table.read().select("id", "file_path", "uuid", "source_folder", "sharpness_score", "analysis_status")


_S6 = """WITH h AS (SELECT *, CASE WHEN id % 3 > 0 THEN CONCAT('old-', CAST(id AS VARCHAR)) END AS own FROM photos WHERE id % 2 = 0), b AS (SELECT * FROM photos WHERE id % 3 = 0)
    SELECT COALESCE(h.id, b.id) AS id, COALESCE(h.file_path, b.file_path) AS file_path, COALESCE(h.own, b.uuid) AS uuid, CASE WHEN h.id IS NULL THEN '/new' ELSE h.source_folder END AS source_folder,
      CASE WHEN b.id IS NULL THEN h.sharpness_score ELSE b.sharpness_score + 1 END AS sharpness_score, CASE WHEN b.id IS NULL THEN h.analysis_status ELSE 'done' END AS analysis_status FROM h FULL OUTER JOIN b ON h.file_path = b.file_path"""


def s8_upsert_decisions(spark, sf_dir):
    """Every photo of the comparisons is decided anew, twice: the winner's later keep counts."""
    both = views.comparisons(spark, sf_dir)
    first = both.select(F.col("winner_id").alias("image_id"), F.lit("maybe").alias("decision"), "decided_at", F.lit(1).alias("seq"))
    second = both.select(F.col("winner_id").alias("image_id"), F.lit("keep").alias("decision"), "decided_at", F.lit(2).alias("seq"))
    wrong = both.select(F.col("loser_id").alias("image_id"), F.lit("burn").alias("decision"), "decided_at", F.lit(3).alias("seq"))
    table = _table(views.decisions(spark, sf_dir), "image_id")
    buckets.put_decisions(table, first.unionByName(second).unionByName(wrong), "review", 1)
    return table.read().select("image_id", "decision")


def s13_backfill_log(spark, sf_dir):
    photos = views.photos(spark, sf_dir)
    log = photos.where("id % 2 = 0").select(F.col("uuid").alias("sample_uuid"), "camera", "lens_model", "film_simulation", "overall_score")
    return catalog.backfill_shooting_log(photos, log)


def c21_move_plan(spark, sf_dir):
    """Decided photos under names that many of them share, with one folder for the keeps of even users, and a file there for every ninth."""
    name = F.concat(F.lit("IMG"), F.element_at(F.array(F.lit(""), F.lit("_1"), F.lit("_2"), F.lit("_1_1")), (F.pmod("id", F.lit(4)) + 1).cast("int")), F.lit(".jpg"))
    photos, decided = views.photos(spark, sf_dir).withColumn("filename", name).withColumn("file_path", F.concat("source_folder", F.lit("/"), "filename")), views.decisions(spark, sf_dir)
    user = F.substring("source_folder", 9, 9).cast("int")
    settings = photos.select("source_folder").distinct().where(user % 2 == 0).select("source_folder", F.lit("keep").alias("decision"), F.concat(F.lit("/best/"), user % 50).alias("dest_folder"))
    there = photos.where("id % 9 = 0").select(F.concat("source_folder", F.lit("/_Trash/"), "filename").alias("path"))
    return catalog.move_plan(photos, decided, settings, there).select("id", "dest_path")


#: One photo after another within each folder: the first name that neither a file nor an earlier photo has.
_C21 = """WITH RECURSIVE w AS (SELECT id, 'IMG' || CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN '_1' WHEN 2 THEN '_2' ELSE '_1_1' END AS stem, id % 9 AS file,
      CASE WHEN decision = 'keep' AND CAST(SUBSTR(source_folder, 9) AS INT) % 2 = 0 THEN '/best/' || (CAST(SUBSTR(source_folder, 9) AS INT) % 50) WHEN decision = 'keep' THEN source_folder || '/_Keeps' WHEN decision = 'maybe' THEN source_folder || '/_Maybes' ELSE source_folder || '/_Trash' END AS dest FROM photos JOIN decisions ON id = image_id),
    t AS (SELECT source_folder || '/_Trash' AS dest, LIST(DISTINCT 'IMG' || CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN '_1' WHEN 2 THEN '_2' ELSE '_1_1' END) AS files FROM photos WHERE id % 9 = 0 GROUP BY 1),
    n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dest ORDER BY id) AS k FROM w),
    s AS (SELECT DISTINCT w.dest, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, '' AS name, COALESCE(t.files, CAST([] AS VARCHAR[])) AS taken FROM w LEFT JOIN t ON t.dest = w.dest
      UNION ALL SELECT dest, k, id, name, LIST_APPEND(taken, name) FROM (SELECT s.dest, n.k, n.id, s.taken, LIST_FILTER(LIST_TRANSFORM(RANGE(LEN(s.taken) + 1), lambda i: CASE WHEN i = 0 THEN n.stem ELSE n.stem || '_' || i END), lambda x: NOT LIST_CONTAINS(s.taken, x))[1] AS name FROM s JOIN n ON n.dest = s.dest AND n.k = s.k + 1) z)
    SELECT id, dest || '/' || name || '.jpg' AS dest_path FROM s WHERE id IS NOT NULL"""


def w5_stream_bursts(spark, sf_dir):
    """Sessions of each user in the stream of events, with gaps of up to two hours.

    A session is given when the stream's time has passed it, so a second run brings a row without a user a day
    after the last event, which closes those still open; it is alone and no burst itself.
    """
    folder = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    columns = (F.col("ts").cast("timestamp").alias("shot_at"), F.col("user_id").cast("long").alias("user_id"))
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = table.agg(F.max("ts").alias("ts")).select((F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("shot_at"), F.lit(None).cast("long").alias("user_id"))
    last.limit(0).write.parquet(f"{folder}/closing")
    events = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parquet*").select(*columns)
    closing = spark.readStream.schema(last.schema).parquet(f"{folder}/closing")
    found = watch.stream_bursts(events.unionByName(closing), "user_id", "2 hours", "0 seconds")
    for rows in (None, last):
        if rows is not None:
            rows.write.mode("append").parquet(f"{folder}/closing")
        query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    return rows.select("user_id", views.second_text("first_shot").alias("first_shot"), "size")


_W5 = """WITH e AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    r AS (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
    SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS first_shot, COUNT(*) AS size FROM r GROUP BY user_id, run HAVING COUNT(*) > 1"""


def _shared(spark):
    found = written(spark.range(1)).inputFiles()[0]
    return found.rsplit("/", 2)[0]


QUERIES = {
    "s3_skip_done": (s3_skip_done, "SELECT id, file_path AS path FROM photos WHERE NOT (id % 2 = 0 AND analysis_status = 'done')"),
    "s4_unfinished": (s4_unfinished, "SELECT '/shoot' AS folder_path, COUNT(*) AS total_on_disk, COUNT(*) FILTER (WHERE id % 2 = 0 AND id % 3 > 0 AND analysis_status = 'done') AS done_count, COUNT(*) FILTER (WHERE NOT (id % 2 = 0 AND id % 3 > 0 AND analysis_status = 'done')) AS unfinished FROM photos WHERE id % 5 > 0"),
    "s5_removed": (s5_removed, "SELECT id, file_path FROM photos WHERE source_folder = '/shoot/u7' AND id % 4 = 0"),
    "s6_upsert_images": (s6_upsert_images, _S6),
    "s8_upsert_decisions": (s8_upsert_decisions, "SELECT image_id, decision FROM decisions WHERE image_id NOT IN (SELECT winner_id FROM comparisons) UNION ALL SELECT DISTINCT winner_id, 'keep' FROM comparisons"),
    "s13_backfill_log": (s13_backfill_log, "SELECT uuid AS sample_uuid, camera, CASE WHEN id % 2 = 0 THEN lens_model END AS lens_model, CASE WHEN id % 2 = 0 THEN film_simulation END AS film_simulation, overall_score FROM photos"),
    "c21_move_plan": (c21_move_plan, _C21),
    "w5_stream_bursts": (w5_stream_bursts, _W5),
}
