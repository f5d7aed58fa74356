"""Listing files and keeping the catalog's tables.

Upserts are pure: they take the table and a batch and return the new table. buckets.BucketTable applies them to the
buckets that a batch touches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DECISION_FOLDERS, DECISIONS, PHOTO_EXTENSIONS
from ..functions.scalars import file_name, parent_folder
from ..storage import written

#: Columns of a photo that an upsert of analysis results leaves as they are.
KEPT_ON_CONFLICT = ("id", "imported_at", "manual_group_id", "explanation", "source_folder")
#: Columns of the sharpness report.
SHARPNESS_REPORT = ("filename", "normalized_score", "p90_laplacian_variance", "p90_tenengrad", "p90_modified_laplacian", "raw_score", "width", "height", "classification", "camera", "path")
#: Tables that a reset empties, by what is to be wiped.
RESETS = {"log": ("shooting_log",), "model": ("training_samples", "pairwise_comparisons"), "all": ("decisions", "burst_members", "bursts", "images")}


def is_photo(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*PHOTO_EXTENSIONS)


def in_decision_folder(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda part: part.isin(*DECISION_FOLDERS.values()))


def plain_path(path: Column) -> Column:
    """A path as the catalog has it: Spark's readers differ in how they begin those of local files, so these begin with their first slash."""
    return F.regexp_replace(path, "^file:/+", "/")


def below(path: Column, root: str) -> Column:
    """What of a path follows the root folder, with its slash; null for paths elsewhere."""
    plain, start = plain_path(path), re.sub("^file:/+", "/", root).rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(start)), F.substring(plain, F.lit(len(start)), F.length(plain)))


def photo_paths(files: DataFrame, recursive: bool = True, root: str = "/") -> DataFrame:
    """Files (path, ...) that are photos below the root; in a recursive listing none in decision folders below it, in another one none in any folder below it.

    A decision folder that the root itself lies in, or is, hides nothing.
    """
    rest = below(F.col("path"), root)
    photos = files.where(is_photo(F.col("path")) & rest.isNotNull())
    return photos.where(~in_decision_folder(rest)) if recursive else photos.where(F.size(F.split(rest, "/")) == 2)


def scan_photos(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length) of the photos in a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select(plain_path(F.col("path")).alias("path"), "modificationTime", "length")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    return photo_paths(files, recursive, root)


def load_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Decoded images (image.origin, height, width, nChannels, mode, data; samples in order blue, green, red) of one folder, or of some.

    The driver holds the list of all files of these folders: load_image_folders() bounds it.
    """
    return spark.read.format("image").option("dropInvalid", "false").load(path)


def load_image_folders(spark: SparkSession, path: str, at_once: int = 4) -> Iterator[DataFrame]:
    """load_images() of the folder itself and of the folders in it, a few at once, so that the driver holds the files of these only.

    Each frame is to be written before the next is asked for. Folders further down aren't read. A folder's own files are held as a whole.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    folders = [x.getPath().toString() for x in found if x.isDirectory() and not x.getPath().getName().startswith(("_", "."))]
    if len(folders) < len(found) or not found:
        yield load_images(spark, path)
    for start in range(0, len(folders), at_once):
        yield load_images(spark, folders[start : start + at_once])


def skip_done(candidates: DataFrame, images: DataFrame) -> DataFrame:
    """S3: candidates (path) without a finished row."""
    return candidates.join(images.where("analysis_status = 'done'").select(F.col("file_path").alias("path")), "path", "left_anti")


def unfinished(candidates: DataFrame, images: DataFrame, root: str, recursive: bool = True) -> DataFrame:
    """(folder_path, total_on_disk, done_count, unfinished) of one root: its photos on disk, and those of them that are done as images of this source folder.

    candidates (path). One row, of zeros where nothing is on disk.
    """
    root = root.rstrip("/") or "/"
    on_disk = photo_paths(candidates, recursive, root).select("path")
    done = images.where((F.col("analysis_status") == "done") & (F.col("source_folder") == root)).select(F.col("file_path").alias("path"), F.lit(1).alias("done")).dropDuplicates(["path"])
    n, ready = F.count("*"), F.count("done")
    return on_disk.join(done, "path", "left").agg(F.lit(root).alias("folder_path"), n.alias("total_on_disk"), ready.alias("done_count"), (n - ready).alias("unfinished"))


def sync_missing(images: DataFrame, files: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(survivors, removed) of the images, removed being those of the folder whose file is gone."""
    gone = images.where(F.col("source_folder") == folder).join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    return images.join(gone.select("file_path"), "file_path", "left_anti").select(*images.columns), gone.select(*images.columns)


def upsert_images(target: DataFrame, batch: DataFrame, status: str = "done") -> DataFrame:
    """Target with the batch put in by file_path.

    A row that exists keeps its uuid if it has one, and KEPT_ON_CONFLICT; its other columns are the batch's
    where the batch has them. Of several batch rows for a file the last by `seq` counts (any, without seq).
    """
    order = F.col("seq") if "seq" in batch.columns else F.lit(0)
    latest = batch.withColumn("__n", F.row_number().over(Window.partitionBy("file_path").orderBy(order.desc()))).where("__n = 1").drop("__n")
    old, new = target.alias("old"), latest.withColumn("__new", F.lit(True)).alias("new")
    met = old.join(new, F.col("old.file_path") == F.col("new.file_path"), "full_outer")
    hit = F.col("new.__new").isNotNull()

    def column(c: str) -> Column:
        was = F.col(f"old.{c}")
        if c == "file_path":
            return F.coalesce(was, F.col(f"new.{c}"))
        if c == "analysis_status":
            return F.when(hit, F.lit(status)).otherwise(was)
        if c not in batch.columns:
            return was
        now = F.col(f"new.{c}")
        if c == "uuid":
            return F.coalesce(was, now)
        if c in KEPT_ON_CONFLICT:
            return F.when(was.isNull() & F.col("old.file_path").isNull(), now).otherwise(was)
        return F.when(hit, now).otherwise(was)

    return met.select(*(column(c).cast(target.schema[c].dataType).alias(c) for c in target.columns))


def error_rows(target: DataFrame, failed: DataFrame) -> DataFrame:
    """Failed (file_path, and what else is known) put in with status error."""
    return upsert_images(target, failed, "error")


def latest_wins(target: DataFrame, batch: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """target with the batch's rows in place of those of the same key; within the batch the last by `order`.

    The target's rows are untouched by the window: it numbers the batch alone.
    """
    last = batch.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last()))).where("__n = 1")
    last = last.select(*(F.col(c) if c in batch.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns))
    return target.join(last.select(key), key, "left_anti").select(*target.columns).unionByName(last)


def loggable(batch: DataFrame) -> DataFrame:
    return batch.where("sample_uuid is not null and sample_uuid <> ''")


def valid_decisions(batch: DataFrame) -> DataFrame:
    return batch.where(F.col("decision").isin(*DECISIONS))


def manual_samples(batch: DataFrame) -> DataFrame:
    return batch.where(F.col("decision").isin(*DECISIONS) & F.col("sample_uuid").isNotNull() & ~F.coalesce("is_auto", F.lit(False)))


def upsert_shooting_log(target: DataFrame, batch: DataFrame) -> DataFrame:
    """By sample_uuid; rows without one are skipped."""
    return latest_wins(target, loggable(batch), "sample_uuid")


def upsert_decisions(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The latest valid decision of a photo."""
    return latest_wins(target, valid_decisions(batch), "image_id")


def upsert_training_samples(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Of manual decisions on photos with a uuid."""
    return latest_wins(target, manual_samples(batch), "sample_uuid")


def undo_decisions(decided: DataFrame, samples: DataFrame, images: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows of the photos in ids (id)."""
    uuids = images.join(ids.select("id"), "id", "left_semi").select(F.col("uuid").alias("sample_uuid"))
    return decided.join(ids.select(F.col("id").alias("image_id")), "image_id", "left_anti").select(*decided.columns), samples.join(uuids, "sample_uuid", "left_anti").select(*samples.columns)


def delete_images(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the photos in ids (id): their decisions, their places in bursts, bursts whose hero they are, and themselves.

    The places of other photos in such a burst go with it. tables by name; those that hold none of these (samples, log) and
    names that aren't there stay as they are.
    """
    keys = {"decisions": "image_id", "burst_members": "image_id", "bursts": "hero_image_id", "images": "id"}
    gone = ids.select("id").distinct()
    out = dict(tables)
    if {"bursts", "burst_members"} <= tables.keys():
        without = tables["bursts"].join(gone.withColumnRenamed("id", "hero_image_id"), "hero_image_id", "left_semi").select(F.col("id").alias("burst_id"))
        tables = tables | {"burst_members": tables["burst_members"].join(without, "burst_id", "left_anti").select(*tables["burst_members"].columns)}
    for name, key in keys.items():
        if name in tables:
            out[name] = tables[name].join(gone.withColumnRenamed("id", key), key, "left_anti").select(*tables[name].columns)
    return out


def backfill_source_folder(images: DataFrame) -> DataFrame:
    """S12."""
    return images.withColumn("source_folder", F.coalesce("source_folder", parent_folder(F.col("file_path"))))


def backfill_shooting_log(images: DataFrame, log: DataFrame) -> DataFrame:
    """Log with the photos that it lacks, lens and film unknown; again, it changes nothing."""
    rows = images.where("uuid is not null").withColumnRenamed("uuid", "sample_uuid").dropDuplicates(["sample_uuid"])
    new = rows.join(log.select("sample_uuid"), "sample_uuid", "left_anti")
    known = [c for c in log.columns if c in new.columns and c not in ("lens_model", "film_simulation")]
    return log.unionByName(new.select(*known), allowMissingColumns=True)


def null_stale_features(samples: DataFrame, keys: list[str], version: int) -> DataFrame:
    """Named features become null where they are present, and those rows get the version; malformed JSON stays as it is."""
    values = F.from_json("features_json", "map<string,double>")
    stale = F.coalesce(F.exists(F.map_keys(values), lambda k: k.isin(*keys)), F.lit(False))
    cleaned = F.to_json(F.transform_values(values, lambda k, v: F.when(~k.isin(*keys), v)), {"ignoreNullFields": "false"})
    return samples.withColumns({"features_json": F.when(stale, cleaned).otherwise(F.col("features_json")), "schema_version": F.when(stale, F.lit(version)).otherwise(F.col("schema_version"))})


def null_stale_columns(images: DataFrame, columns: list[str]) -> DataFrame:
    """S15."""
    return images.withColumns({c: F.lit(None).cast(images.schema[c].dataType) for c in columns})


def export_sharpness_csv(scores: DataFrame, path: str) -> None:
    """Scores with the columns SHARPNESS_REPORT."""
    scores.select(*SHARPNESS_REPORT).write.mode("overwrite").csv(path, header=True)


def subfolder_photo_counts(files: DataFrame, root: str) -> DataFrame:
    """(subfolders): immediate subfolders of the root, no decision folders, that hold a photo at any depth."""
    rest = F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    inside = files.where(F.startswith("path", F.lit(root.rstrip("/") + "/"))).where(is_photo(F.col("path")))
    first = F.when(F.size(F.split(rest, "/")) > 1, F.split(rest, "/")[0])
    return inside.select(first.alias("f")).where(F.col("f").isNotNull() & ~F.col("f").isin(*DECISION_FOLDERS.values())).agg(F.count_distinct("f").alias("subfolders"))


def reset(tables: dict[str, DataFrame], what: str) -> dict[str, DataFrame]:
    """The tables with those that `what` (a key of RESETS) names empty, of the same columns."""
    return {name: df.sparkSession.createDataFrame([], df.schema) if name in RESETS[what] else df for name, df in tables.items()}


#: A stem as a number behind another stem, as numbered names have it.
NUMBERED = r"(?s)^(.+)_([1-9]\d{0,8})$"


def _named(rows: DataFrame) -> DataFrame:
    """rows (dest, name) with stem, ext and parent: the stem whose photos may ask for this name with a number, null for none."""
    split = r"(?s)^(.+?)(\.[^.]+)?$"
    parts = rows.withColumns({"stem": F.regexp_extract("name", split, 1), "ext": F.regexp_extract("name", split, 2)})
    return parts.withColumn("parent", F.nullif(F.regexp_extract("stem", NUMBERED, 1), F.lit("")))


def _families(stems: DataFrame) -> DataFrame:
    """(dest, ext, stem, family) of distinct stems (dest, ext, stem, parent): the first of the chain of parents that are stems there too.

    Every round halves the chains, so IMG_1_1 behind IMG_1 behind IMG takes two; mostly no stem is another's parent.
    """
    here = stems.select("dest", "ext", F.col("stem").alias("parent"), F.lit(True).alias("known"))
    found = written(stems.join(here, ["dest", "ext", "parent"], "left").select("dest", "ext", "stem", F.when(F.col("known"), F.col("parent")).otherwise(F.col("stem")).alias("family")))
    while True:
        above = found.where("family <> stem").select("dest", "ext", F.col("stem").alias("family"), F.col("family").alias("higher"))
        if above.isEmpty():
            return found
        moved = written(found.join(above, ["dest", "ext", "family"], "left").withColumn("moved", F.col("higher").isNotNull()).select("dest", "ext", "stem", F.coalesce("higher", "family").alias("family"), "moved"))
        found = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return found


def _first_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family keys, files first, then photos by id): the first free name of each photo; what is held is the names of one family."""
    family, taken, following = None, set(), {}
    for batch in batches:
        ids, names = [], []
        for dest, ext, key, id, stem in zip(*(batch.column(c).to_pylist() for c in ("dest", "ext", "family", "id", "stem")), strict=True):
            if (dest, ext, key) != family:
                family, taken, following = (dest, ext, key), set(), {}
            if id is None:
                taken.add(stem)
                continue
            n = following.get(stem, 0)
            while (own := f"{stem}_{n}" if n else stem) in taken:
                n += 1
            taken.add(own)
            following[stem] = n + 1
            ids.append(id)
            names.append(own + ext)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string())], ["id", "dest_name"])


def move_plan(images: DataFrame, decided: DataFrame, folder_settings: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, file_path, dest_path) for decided photos that aren't in place; nothing is moved.

    folder_settings (source_folder, decision, dest_folder); existing (path) of files at the destinations. In order
    of id every photo gets the first free of name, name_1, name_2, ...; what an existing file or an earlier photo has is taken. Photos that
    may ask for one another's names are a family: those of one name in a folder, and those whose name is another's with a number. A family
    of one photo and no file keeps its name; each of the others is walked once in order, however many names collide.
    """
    from ..functions.scores import decision_folder

    rows = images.join(decided.select(F.col("image_id").alias("id"), "decision"), "id").join(folder_settings, ["source_folder", "decision"], "left")
    dest = decision_folder(F.col("decision"), F.col("source_folder"), F.col("dest_folder"))
    rows = rows.select("id", "file_path", dest.alias("dest"), file_name(F.col("file_path")).alias("name")).where(F.concat("dest", F.lit("/"), "name") != F.col("file_path"))
    rows = written(_named(rows))
    families = _families(rows.select("dest", "ext", "stem", "parent").distinct())
    photos = rows.select("id", "dest", "ext", "stem").join(families, ["dest", "ext", "stem"])
    # A file is in the way of its own stem's photos and of those that may ask for its name with a number; where both are there, they are one family.
    there = _named(existing.select(parent_folder(F.col("path")).alias("dest"), file_name(F.col("path")).alias("name")).distinct())
    either = there.select("dest", "ext", F.col("stem").alias("own"), F.explode(F.array_compact(F.array("stem", "parent"))).alias("stem"))
    files = either.join(families, ["dest", "ext", "stem"]).select("dest", "ext", "family", F.col("own").alias("stem")).distinct()
    # Written, as a union of joins passes for dealt by their keys even where these joins become broadcasts later.
    both = written(photos.select("dest", "ext", "family", "id", "stem").unionByName(files.withColumn("id", F.lit(None).cast(photos.schema["id"].dataType))))
    alone = both.groupBy("dest", "ext", "family").agg(F.count("*").alias("n")).where("n = 1").select("dest", "ext", "family")
    contested = both.join(alone, ["dest", "ext", "family"], "left_anti").repartition("dest", "ext", "family")
    contested = contested.sortWithinPartitions("dest", "ext", "family", F.col("id").asc_nulls_first())
    renamed = contested.select("dest", "ext", "family", F.col("id").cast("long").alias("id"), "stem").mapInArrow(_first_free, "id bigint, dest_name string")
    return rows.join(renamed, "id", "left").select("id", "file_path", F.concat("dest", F.lit("/"), F.coalesce("dest_name", "name")).alias("dest_path"))
