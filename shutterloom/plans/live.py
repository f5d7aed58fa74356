"""Queries on streams run to their end, vectors, and the rest of the table jobs."""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from ..config import FEATURES, SCENES
from ..functions import scalars
from ..operators import browse, decide, learn, similarity
from ..sources import buckets, catalog
from ..storage import settings, small_files, written
from ..streaming import watch
from . import views


#: Files of a folder of images that the driver is to list, some.
FOLDER_FILES = 10_000


def _folder(spark) -> str:
    """A new folder beside the written tables."""
    return f"{written(spark.range(1)).inputFiles()[0].rsplit('/', 2)[0]}/stream-{uuid.uuid4().hex}"


def _photo_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return spark.sql(views.PHOTOS, events=spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"))


def w2_deletes(spark, sf_dir):
    """The files of every third photo are deleted, those of the others come."""
    kind = F.when(F.col("id") % 3 == 0, "deleted").otherwise("created").alias("kind")
    tables = [views.photos(spark, sf_dir).select("id", "file_path")]
    stream = _photo_stream(spark, sf_dir).select(kind, F.col("file_path").alias("path"))
    watch.ingest(stream, lambda batch, n: tables.append(written(watch.apply_deletes(tables[-1], batch))), _folder(spark), True).awaitTermination()
    return tables[-1]


def w3_failures(spark, sf_dir):
    """Every fifth photo couldn't be measured; of those only even ones still have their file."""
    existing = views.photos(spark, sf_dir).where("id % 2 = 0").select(F.col("file_path").alias("path"))
    stream = _photo_stream(spark, sf_dir).select("file_path", F.struct(F.when(F.col("id") % 5 > 0, F.col("value")).alias("mean")).alias("pixels"))
    found = []

    def route(batch, n):
        measured, failed = watch.route_failures(batch, existing)
        outcome = lambda rows, name: rows.select("file_path", F.lit(name).alias("outcome"))
        found.append(written(outcome(measured, "measured").unionByName(outcome(failed, "error"))))

    watch.ingest(stream, route, _folder(spark), True).awaitTermination()
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def w4_progress(spark, sf_dir):
    """How many photos have which status when the stream has ended."""
    counts, found = watch.watch_progress(_photo_stream(spark, sf_dir).select(F.col("analysis_status").alias("status"))), []
    writer = counts.writeStream.outputMode("complete").foreachBatch(lambda batch, n: found.append(written(batch)))
    writer.option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return found[-1].select("status", F.col("count").alias("n"))


def _bitmap(body: bytes) -> bytes:
    """A grey BMP of 64 columns of the bytes, padded with zeros to whole rows."""
    rows = max(1, -(-len(body) // 64))
    body = body.ljust(64 * rows, b"\0")
    palette = b"".join(bytes((v, v, v, 0)) for v in range(256))
    head = struct.pack("<2sIII", b"BM", 1078 + len(body), 0, 1078) + struct.pack("<IiiHHIIiiII", 40, 64, rows, 1, 8, 0, len(body), 0, 0, 256, 0)
    return head + palette + b"".join(body[64 * y : 64 * y + 64] for y in reversed(range(rows)))


def _frame_files(docs, folder: str, parts: int = 0) -> None:
    """Writes an image file for each of docs (doc_id, text), named by its id; of every fiftieth only the beginning. With parts, into that many folders by the id."""

    def write(batches):
        files, top = fs.FileSystem.from_uri(folder)
        for n in range(parts):
            files.create_dir(f"{top}/{n}", recursive=True)
        files.create_dir(top, recursive=True)
        n = 0
        for batch in batches:
            for id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = _bitmap((text or "").encode())
                root = f"{top}/{id % parts}" if parts else top
                with files.open_output_stream(f"{root}/_{id}") as out:
                    out.write(data[:40] if id % 50 == 7 else data)
                files.move(f"{root}/_{id}", f"{root}/doc-{id}.png")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    # Dealt by id, as few partitions of large rows would leave most tasks without files to write.
    docs.repartition("doc_id").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def s2_images(spark, sf_dir):
    """Every document's bytes as the file of a grey image, read back; the ones that are cut off have no size."""
    folder, docs = _folder(spark), _documents(spark, sf_dir)
    _frame_files(docs, f"{folder}/frames", -(-docs.count() // FOLDER_FILES))
    known = lambda c: F.when(F.col("image.height") > 0, F.col(f"image.{c}"))
    with settings(spark, small_files(spark)):
        for images in catalog.load_image_folders(spark, f"{folder}/frames"):
            found = images.select(F.regexp_extract("image.origin", r"doc-(\d+)\.png", 1).cast("long").alias("doc_id"), "image")
            rows = found.select("doc_id", known("height").alias("height"), known("width").alias("width"), F.when(known("height").isNotNull(), F.octet_length("image.data")).cast("long").alias("bytes"))
            rows.write.mode("append").parquet(f"{folder}/rows")
    return spark.read.schema("doc_id bigint, height int, width int, bytes bigint").parquet(f"{folder}/rows")


def w1_watched_folder(spark, sf_dir):
    """Images of the documents put into a folder in two lots, each followed by a run of one checkpoint: a row for each file, those that are cut off as errors."""
    folder, docs = _folder(spark), _documents(spark, sf_dir)
    empty = spark.createDataFrame([], "file_path string, filename string, uuid string, overall_score double, analysis_status string")
    images = buckets.BucketTable(spark, f"{folder}/images", empty.schema, "file_path", 16)
    images.create(empty)
    log = buckets.BucketTable(spark, f"{folder}/log", spark.createDataFrame([], "sample_uuid string, overall_score double").schema, "sample_uuid", 16)
    log.create(spark.createDataFrame([], log.schema))

    def score(rows):
        return rows.select("file_path", scalars.file_name(F.col("file_path")).alias("filename"), F.sha1("file_path").alias("uuid"), F.round("pixels.mean", 4).alias("overall_score"))

    for lot in range(2):
        _frame_files(docs.where(F.col("doc_id") % 2 == lot), f"{folder}/in")
        listing = lambda: catalog.scan_photos(spark, f"{folder}/in", False)
        with settings(spark, small_files(spark) | views.FRAMES):
            watch.watch_into(spark, f"{folder}/in", images, log, score, listing, f"{folder}/state", True).awaitTermination()
    logged = log.read().select(F.col("sample_uuid").alias("uuid"), F.lit(True).alias("logged"))
    name = F.regexp_extract("file_path", r"doc-(\d+)\.png", 1).cast("long")
    return images.read().join(logged, "uuid", "left").select(name.alias("doc_id"), "analysis_status", "overall_score", F.coalesce("logged", F.lit(False)).alias("logged"))


_SIZES = "SELECT doc_id, doc_id % 50 = 7 AS cut, CAST(GREATEST(1, CEIL(STRLEN(COALESCE(text, '')) / 64.0E0)) AS INT) AS h FROM documents"
_W1 = f"""WITH d AS ({_SIZES}), c AS (SELECT doc_id, SUM(CAST('0x' || SUBSTR(x, CAST(2 * k + 1 AS BIGINT), 2) AS INT)) AS s FROM (SELECT doc_id, HEX(ENCODE(text)) AS x, UNNEST(RANGE(STRLEN(text))) AS k FROM documents) t GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN cut THEN 'error' ELSE 'done' END AS analysis_status, CASE WHEN NOT cut THEN ROUND(COALESCE(s, 0) / (64.0E0 * h), 4) END AS overall_score, NOT cut AS logged FROM d LEFT JOIN c ON c.doc_id = d.doc_id"""


def w6_retrain(spark, sf_dir):
    """When decisions of twenty owners, every seventh a keep, call for a training."""
    owner = F.concat(F.lit("owner-"), (F.col("id") % 20).cast("string")).alias("owner")
    due = watch.retrain_trigger(_photo_stream(spark, sf_dir).where("id % 7 < 3").select(owner, F.col("id").alias("image_id")))
    folder = _folder(spark)
    writer = due.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("owner string, samples bigint").parquet(f"{folder}/out")


def s1_photo_paths(spark, sf_dir):
    """A root that lies in a decision folder itself. Some files are texts, some have capitals in their extension, some lie in decision folders below it, some beside it."""
    kind = F.element_at(F.array(*map(F.lit, (".txt", ".Tiff", ".NEF", ".jpg.bak", ".png"))), (F.col("id") % 5 + 1).cast("int"))
    below = F.when(F.col("id") % 3 == 0, "/_Trash/").when(F.col("id") % 4 == 0, "/_Keeps2/").otherwise("/")
    top = F.when(F.col("id") % 7 == 0, "/cards/_Keeps2").otherwise("/cards/_Keeps")
    return catalog.photo_paths(views.photos(spark, sf_dir).select("id", F.concat(top, "source_folder", below, F.lit("x"), "id", kind).alias("path")), True, "/cards/_Keeps")


def s16_report(spark, sf_dir):
    """The sharpness report as it is read back from its file."""
    p, path = views.photos(spark, sf_dir), f"{_folder(spark)}.csv"
    measures = {n: F.col("value") * k for k, n in enumerate(("p90_laplacian_variance", "p90_tenengrad", "p90_modified_laplacian", "raw_score"), 1)}
    rows = p.withColumns(measures | {"normalized_score": F.col("sharpness_score"), "width": F.lit(6000), "height": F.lit(4000), "classification": F.col("scene"), "path": F.col("file_path")})
    catalog.export_sharpness_csv(rows, path)
    back = spark.read.csv(path, header=True)
    return back.select("filename", "camera", "classification", "path", "width", "height", F.col("normalized_score").cast("double").alias("score"), F.round(F.col("raw_score").cast("double"), 4).alias("raw"))


def s17_embedding_text(spark, sf_dir):
    """Every seventh text is cut off, every fifth is an empty list."""
    text = scalars.encode_embedding(F.col("embedding"))
    text = F.when(F.col("id") % 7 == 0, F.substring(text, 1, 20)).when(F.col("id") % 5 == 0, "[]").otherwise(text)
    back = views.vectors(spark, sf_dir).select("id", scalars.decode_embedding(text).alias("v"))
    return back.select("id", F.when(F.col("v").isNotNull(), F.size("v")).cast("long").alias("n"), F.round(F.col("v")[0].cast("double"), 4).alias("first"))


def s20_reset(spark, sf_dir):
    """Rows left of each table after each kind of reset."""
    p, d = views.photos(spark, sf_dir), views.decisions(spark, sf_dir)
    tables = {"images": p, "decisions": d, "shooting_log": views.shooting_log(spark, sf_dir), "training_samples": d, "pairwise_comparisons": views.comparisons(spark, sf_dir)}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit(name).alias("kind"), "n") for what in catalog.RESETS for name, df in catalog.reset(tables, what).items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _axis(n: int, size: int = 64) -> list[float]:
    return [float(k == n) for k in range(size)]


def c15_scenes(spark, sf_dir):
    """Scenes whose vectors are the first eight axes."""
    return browse.tag_scene(views.vectors(spark, sf_dir), {name: _axis(n) for n, name in enumerate(SCENES)}).select("id", "scene", F.round("scene_confidence", 3).alias("confidence"))


def c16_axes(spark, sf_dir):
    """Two axes between neighbouring directions; eye contact only of every third photo, which has a face."""
    rows = views.vectors(spark, sf_dir).withColumn("face_detected", F.when(F.col("id") % 3 == 0, 1).otherwise(0))
    found = browse.concept_axes(rows, {"mood_score": (_axis(0), _axis(1)), "eye_contact_score": (_axis(2), _axis(3))})
    return found.select("id", F.round("mood_score", 3).alias("mood"), F.round("eye_contact_score", 3).alias("eye_contact"))


def c19_cosine(spark, sf_dir):
    """Each vector with the next one, every ninth of them all zeros."""
    v = views.vectors(spark, sf_dir).select("id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    left = v.select("id", F.when(F.col("id") % 9 == 0, F.transform("v", lambda x: F.lit(0.0))).otherwise(F.col("v")).alias("a"))
    right = v.select((F.col("id") - 1).alias("id"), F.col("v").alias("b"))
    return left.join(right, "id").select("id", F.round(scalars.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


def g5_people(spark, sf_dir):
    """All vectors as faces, whatever their time; a few of them are alike by 0.4."""
    photos = views.vectors(spark, sf_dir).select("id", F.col("embedding").alias("face_embedding"), "shot_at", F.when(F.col("id") % 10 == 0, "pending").otherwise("done").alias("analysis_status"), F.when(F.col("id") % 6 == 1, 0).otherwise(1).alias("face_detected"))
    return similarity.face_groups(photos, 0.4)


def d6_trash(spark, sf_dir):
    """What goes, and what is left of each table after it."""
    d = views.decisions(spark, sf_dir)
    gone, left = decide.trash_rejects({"images": views.photos(spark, sf_dir), "decisions": d})
    counted = lambda rows, name, key: rows.agg(F.count("*").alias("n"), F.sum(key).alias("ids")).select(F.lit(name).alias("kind"), "n", "ids")
    return counted(gone, "gone", "id").unionByName(counted(left["images"], "images", "id")).unionByName(counted(left["decisions"], "decisions", "image_id"))


def m2_features_json(spark, sf_dir):
    """Features written as text and read again: how many are known and their sum, and whether the text is whole."""
    photos = views.photos(spark, sf_dir)
    back = photos.select("id", learn.features_to_json(photos.columns).alias("text")).select("id", *learn.features_from_json(F.col("text")))
    direct = photos.select("id", *(c.alias(f"own_{n}") for n, c in zip(FEATURES, learn.features(photos.columns), strict=True)))
    same = [F.col(n).eqNullSafe(F.col(f"own_{n}")) for n in FEATURES]
    return back.join(direct, "id").agg(F.count("*").alias("n"), *(F.count_if(~s).alias(f"lost_{n}") for n, s in zip(FEATURES, same, strict=True)))


QUERIES = {
    "w2_deletes": (w2_deletes, "SELECT id, file_path FROM photos WHERE id % 3 > 0"),
    "w3_failures": (w3_failures, "SELECT file_path, CASE WHEN id % 5 > 0 AND value IS NOT NULL THEN 'measured' ELSE 'error' END AS outcome FROM photos WHERE (id % 5 > 0 AND value IS NOT NULL) OR id % 2 = 0"),
    "w4_progress": (w4_progress, "SELECT analysis_status AS status, COUNT(*) AS n FROM photos GROUP BY analysis_status"),
    "s2_images": (s2_images, f"SELECT doc_id, CASE WHEN NOT cut THEN h END AS height, CASE WHEN NOT cut THEN 64 END AS width, CASE WHEN NOT cut THEN CAST(64 * h AS BIGINT) END AS bytes FROM ({_SIZES}) d"),
    "w1_watched_folder": (w1_watched_folder, _W1),
    "w6_retrain": (
        w6_retrain,
        "SELECT owner, CAST(UNNEST(GENERATE_SERIES(30, n, 10)) AS BIGINT) AS samples FROM (SELECT 'owner-' || CAST(id % 20 AS VARCHAR) AS owner, COUNT(*) AS n FROM photos WHERE id % 7 < 3 GROUP BY 1) t",
    ),
    "s1_photo_paths": (
        s1_photo_paths,
        "SELECT id, '/cards/_Keeps' || source_folder || CASE WHEN id % 4 = 0 THEN '/_Keeps2/' ELSE '/' END || 'x' || id || CASE id % 5 WHEN 1 THEN '.Tiff' WHEN 2 THEN '.NEF' ELSE '.png' END AS path FROM photos WHERE id % 5 IN (1, 2, 4) AND id % 3 > 0 AND id % 7 > 0",
    ),
    "s16_report": (
        s16_report,
        "SELECT filename, camera, scene AS classification, file_path AS path, '6000' AS width, '4000' AS height, sharpness_score AS score, ROUND(value * 4, 4) AS raw FROM photos",
    ),
    "s17_embedding_text": (
        s17_embedding_text,
        "SELECT id, CASE WHEN id % 7 > 0 AND id % 5 > 0 THEN LEN(embedding) END AS n, CASE WHEN id % 7 > 0 AND id % 5 > 0 THEN ROUND(CAST(embedding[1] AS DOUBLE), 4) END AS first FROM vectors",
    ),
    "s20_reset": (
        s20_reset,
        """WITH t AS (SELECT 'images' AS kind, COUNT(*) AS n FROM photos UNION ALL SELECT 'decisions', COUNT(*) FROM decisions UNION ALL SELECT 'shooting_log', COUNT(*) FROM photos
        UNION ALL SELECT 'training_samples', COUNT(*) FROM decisions UNION ALL SELECT 'pairwise_comparisons', COUNT(*) FROM comparisons),
        e(what, kind) AS (VALUES ('log', 'shooting_log'), ('model', 'training_samples'), ('model', 'pairwise_comparisons'), ('all', 'decisions'), ('all', 'images'))
        SELECT w.what, t.kind, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.what = w.what AND e.kind = t.kind) THEN 0 ELSE t.n END AS n FROM t, (VALUES ('log'), ('model'), ('all')) w(what)""",
    ),
    "c15_scenes": (
        c15_scenes,
        f"WITH l AS (SELECT id, LIST_TRANSFORM(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS v FROM vectors) SELECT id, ([{', '.join(f'{chr(39)}{s}{chr(39)}' for s in SCENES)}])[LIST_POSITION(v, LIST_MAX(v))] AS scene, ROUND(GREATEST(0, ROUND_EVEN(LIST_MAX(v), 4)), 3) AS confidence FROM l",
    ),
    "c16_axes": (
        c16_axes,
        """WITH l AS (SELECT id, LIST_TRANSFORM(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS v FROM vectors)
        SELECT id, ROUND(ROUND_EVEN(1 / (1 + EXP((v[2] - v[1]) / 0.05E0)), 4), 3) AS mood, CASE WHEN id % 3 = 0 THEN ROUND(ROUND_EVEN(1 / (1 + EXP((v[4] - v[3]) / 0.05E0)), 4), 3) END AS eye_contact FROM l""",
    ),
    "c19_cosine": (
        c19_cosine,
        "SELECT a.id, CASE WHEN a.id % 9 = 0 THEN 0 ELSE ROUND(LIST_COSINE_SIMILARITY(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) END AS cosine FROM vectors a JOIN vectors b ON b.id = a.id + 1",
    ),
    "g5_people": (
        g5_people,
        """WITH RECURSIVE f AS (SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM vectors WHERE id % 10 > 0 AND id % 6 <> 1),
        e AS (SELECT a.id AS x, b.id AS y FROM f a JOIN f b ON a.id <> b.id WHERE LIST_DOT_PRODUCT(a.v, b.v) >= 0.4),
        c(x, root) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.x) SELECT MIN(root) AS group_id, x AS id FROM c GROUP BY x""",
    ),
    "d6_trash": (
        d6_trash,
        """WITH r AS (SELECT p.id, d.decision FROM photos p LEFT JOIN decisions d ON d.image_id = p.id) SELECT 'gone' AS kind, COUNT(*) AS n, CAST(SUM(id) AS BIGINT) AS ids FROM r WHERE decision = 'reject'
        UNION ALL SELECT 'images', COUNT(*), CAST(SUM(id) AS BIGINT) FROM r WHERE decision IS NULL OR decision <> 'reject' UNION ALL SELECT 'decisions', COUNT(*), CAST(SUM(id) AS BIGINT) FROM r WHERE decision <> 'reject'""",
    ),
    "m2_features_json": (m2_features_json, f"SELECT COUNT(*) AS n, {', '.join(f'CAST(0 AS BIGINT) AS lost_{n}' for n in FEATURES)} FROM photos"),
}
