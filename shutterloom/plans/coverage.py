"""Queries on single measures, labels, texts and small table jobs, each with a twin written from what it has to give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, scores
from ..operators import browse, dashboard, decide, groups, pixels, similarity
from ..sources import buckets, catalog
from ..storage import settings, written
from . import views
from .tables import _table


def c_labels(spark, sf_dir):
    """C2 to C4, C8 to C11, C14 on every photo; pixel measures stand in from its number."""
    p = views.photos(spark, sf_dir)
    consistency, elongation, angle = (F.pmod("id", F.lit(100)) / 100.0, 1 + F.pmod("id", F.lit(30)) / 10.0, F.pmod("id", F.lit(180)))
    hi, lo = F.pmod("id", F.lit(25)).cast("double"), F.pmod("id", F.lit(12)).cast("double")
    sharp = scores.sharpness_score(F.pmod("id", F.lit(50)) / 10.0)
    raw = F.when(F.col("iqa_score").isNotNull(), F.pmod("id", F.lit(130)) / 100.0)
    iqa, aes = scores.iqa_score(raw), scores.aesthetic_score(F.pmod("id", F.lit(110)) / 10.0)
    return p.select(
        "id",
        F.round(scores.reweighted(F.col("overall_score"), F.col("face_sharpness_score"), F.col("exposure_score"), 0.25), 4).alias("reweighted"),
        sharp.alias("sharp"),
        scores.sharpness_label(sharp).alias("sharp_label"),
        scores.exposure_score(F.col("sharpness_score") * 2 + 0.0123, hi, lo).alias("exposure"),
        scores.shake_score(consistency, elongation).alias("shake"),
        scores.shake_warning(consistency, elongation).alias("shake_label"),
        scores.shake_intentional(angle, consistency).alias("pan"),
        scores.shake_conflict(F.element_at(F.array(*map(F.lit, ("low", "moderate", "high", "unknown"))), (F.pmod("id", F.lit(4)) + 1).cast("int")), scores.shake_warning(consistency, elongation)).alias("conflict"),
        iqa.alias("iqa"),
        scores.iqa_label(iqa).alias("iqa_label"),
        aes.alias("aesthetic"),
        scores.aesthetic_label(aes).alias("aesthetic_label"),
        scores.headline_score(F.col("overall_score"), F.col("face_sharpness_score"), F.col("id") % 2 == 0).alias("headline"),
    )


_LABELS = """WITH q AS (SELECT *, (id % 100) / 100.0E0 AS c, 1 + (id % 30) / 10.0E0 AS e, id % 180 AS angle, CAST(id % 25 AS DOUBLE) AS hi, CAST(id % 12 AS DOUBLE) AS lo,
      LEAST(100, ROUND_EVEN((id % 50) / 10.0E0 / 2.3E0 * 50, 0)) AS sharp, CASE WHEN iqa_score IS NOT NULL THEN ROUND(LEAST(id % 130, 100) * 1.0E0, 1) END AS iqa,
      CASE WHEN id % 110 > 15 THEN ROUND((GREATEST(LEAST((id % 110) / 10.0E0, 10), 1) - 1) / 9 * 100, 1) ELSE ROUND(LEAST((id % 110) / 10.0E0, 1) * 100, 1) END AS aes, ABS(sharpness_score * 2 + 0.0123E0 - 128) AS d FROM photos),
    r AS (SELECT *, CASE WHEN d <= 30 THEN d / 6 WHEN d <= 50 THEN 5 + (d - 30) * 0.65E0 WHEN d <= 80 THEN 18 + (d - 50) * 17 / 30 ELSE 35 + (d - 80) * 15 / 48 END AS dark,
      CASE WHEN hi <= 1 THEN 0.05E0 * hi WHEN hi <= 2 THEN 0.05E0 + (hi - 1) * 0.10E0 WHEN hi <= 5 THEN 0.15E0 + (hi - 2) * 0.10E0 WHEN hi <= 10 THEN 0.45E0 + (hi - 5) * 0.06E0 WHEN hi <= 20 THEN 0.75E0 + (hi - 10) * 0.025E0 ELSE 1.0E0 END AS ph,
      CASE WHEN lo <= 1 THEN 0.05E0 * lo WHEN lo <= 2 THEN 0.05E0 + (lo - 1) * 0.10E0 WHEN lo <= 5 THEN 0.15E0 + (lo - 2) * 0.10E0 WHEN lo <= 10 THEN 0.45E0 + (lo - 5) * 0.06E0 ELSE 0.75E0 + (lo - 10) * 0.025E0 END AS pl FROM q)
    SELECT id, CASE WHEN face_sharpness_score IS NULL THEN overall_score ELSE ROUND((face_sharpness_score + 3 * exposure_score) / 4 + 1E-9, 1) END AS reweighted,
      sharp, CASE WHEN sharp >= 70 THEN 'Sharp' WHEN sharp >= 40 THEN 'Borderline' ELSE 'Blurry' END AS sharp_label,
      CAST(GREATEST(0, ROUND_EVEN(ROUND(100 - dark - 35 * ph - 28 * pl, 9), 0)) AS INT) AS exposure,
      100 - CASE WHEN id % 100 > 70 THEN 50 WHEN id % 100 > 50 THEN 35 WHEN id % 100 > 30 THEN 15 ELSE 0 END - CASE WHEN id % 30 > 20 THEN 30 WHEN id % 30 > 10 THEN 20 WHEN id % 30 > 5 THEN 10 ELSE 0 END AS shake,
      CASE WHEN id % 100 > 70 OR id % 30 > 20 THEN 'severe_shake' WHEN id % 100 > 50 OR id % 30 > 10 THEN 'shake' WHEN id % 100 > 30 OR id % 30 > 5 THEN 'slight_shake' ELSE 'ok' END AS shake_label,
      (angle < 20 OR angle > 160) AND id % 100 > 30 AND id % 100 < 65 AS pan,
      CASE id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'high' END IS NOT NULL AND COALESCE(CASE id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'high' END, '') <> CASE WHEN id % 100 > 50 OR id % 30 > 10 THEN 'high' WHEN id % 100 > 30 OR id % 30 > 5 THEN 'moderate' ELSE 'low' END AS conflict,
      iqa, CASE WHEN iqa IS NULL THEN NULL WHEN iqa >= 75 THEN 'Excellent' WHEN iqa >= 55 THEN 'Good' WHEN iqa >= 35 THEN 'Fair' ELSE 'Poor' END AS iqa_label,
      aes AS aesthetic, CASE WHEN aes >= 46 THEN 'Excellent' WHEN aes >= 42 THEN 'Good' WHEN aes >= 36 THEN 'Fair' ELSE 'Poor' END AS aesthetic_label,
      CASE WHEN id % 2 = 0 THEN COALESCE(face_sharpness_score, overall_score) ELSE overall_score END AS headline FROM r"""


def x_texts(spark, sf_dir):
    """X1 to X3, X5, X6, X8, X11, X12, X14, W7 on texts made of every photo's number."""
    number = F.col("id").cast("string")
    kind = lambda n, *texts: F.element_at(F.array(*(t if not isinstance(t, str) else F.lit(t) for t in texts)), (F.pmod("id", F.lit(n)) + 1).cast("int"))
    fraction = kind(5, F.concat(F.lit("1/"), F.pmod("id", F.lit(250))), F.concat(F.pmod("id", F.lit(7)), F.lit(".5")), "a/b", F.lit(None).cast("string"), " 3 ")
    stamp = kind(3, F.date_format("imported_at", "yyyy:MM:dd HH:mm:ss"), "0000:00:00", F.lit(None).cast("string"))
    iso = kind(4, F.date_format("imported_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("imported_at", "yyyy-MM-dd HH:mm:ss"), number, "never")
    faces = kind(4, "[false, null]", "[true, false]", F.lit(None).cast("string"), "junk")
    elapsed = F.pmod("id", F.lit(4000)).cast("double")
    progress = scalars.progress(F.pmod("id", F.lit(40)), F.lit(40), elapsed)
    return views.photos(spark, sf_dir).select(
        "id",
        F.round(scalars.parse_fraction(fraction), 6).alias("fraction"),
        scalars.camera_name(kind(4, "FUJIFILM X100VI", " X-H2 ", "NIKON Z 6_3", " Other ")).alias("camera_name"),
        scalars.make_and_model(kind(3, "NIKON", "FUJIFILM", ""), kind(3, "Nikon Z", "X-T5 ", "Bare")).alias("make_model"),
        views.second_text(scalars.exif_timestamp(stamp, F.lit("2020:02:03 04:05:06"))).alias("taken"),
        scalars.file_name(F.col("file_path")).alias("file"),
        scalars.parent_folder(F.col("file_path")).alias("folder"),
        scalars.file_format(F.lower("file_path")).alias("file_format"),
        scalars.maker_from_filename(F.concat(kind(3, "DSCF", "DSC_", "IMG_"), number)).alias("maker"),
        scalars.to_unix(iso).alias("unix"),
        scalars.format_duration(elapsed).alias("duration"),
        scalars.all_faces_closed(faces, F.pmod("id", F.lit(3)).cast("int")).alias("closed"),
        scalars.setting_float(kind(3, number, "junk", "-1"), 2.5, 0.0, 5000.0).alias("setting"),
        scalars.setting_bool(kind(4, " YES ", "0", F.lit(None).cast("string"), "on"), True).alias("switch"),
        F.round(progress["pct"], 1).alias("pct"),
        F.round(progress["eta"], 4).alias("eta"),
    )


_TEXTS = """WITH q AS (SELECT *, id % 4000 AS s, CAST(FLOOR((id % 4000) / 3600) AS BIGINT) AS h, CAST(FLOOR((id % 4000) % 3600 / 60) AS BIGINT) AS m FROM photos)
    SELECT id, ROUND(CASE id % 5 WHEN 0 THEN CASE WHEN id % 250 > 0 THEN 1.0E0 / (id % 250) END WHEN 1 THEN id % 7 + 0.5E0 WHEN 4 THEN 3.0E0 END, 6) AS fraction,
      CASE id % 4 WHEN 0 THEN 'X100VI' WHEN 1 THEN 'X Half' WHEN 2 THEN 'Z6III' ELSE 'Other' END AS camera_name, CASE id % 3 WHEN 0 THEN 'Nikon Z' WHEN 1 THEN 'FUJIFILM X-T5' ELSE 'Bare' END AS make_model,
      CASE WHEN id % 3 = 0 THEN STRFTIME(imported_at, '%Y-%m-%d %H:%M:%S') ELSE '2020-02-03 04:05:06' END AS taken, filename AS file, source_folder AS folder, format AS file_format,
      CASE id % 3 WHEN 0 THEN 'Fujifilm' WHEN 1 THEN 'Nikon' ELSE 'Unknown' END AS maker,
      CASE WHEN id % 4 < 2 THEN FLOOR(EPOCH(imported_at)) WHEN id % 4 = 2 THEN CAST(id AS DOUBLE) END AS unix,
      CASE WHEN s = 0 THEN '0s' ELSE CONCAT_WS(' ', CASE WHEN h > 0 THEN h || 'h' END, CASE WHEN m > 0 OR (h > 0 AND s % 60 > 0) THEN m || 'm' END, CASE WHEN s % 60 > 0 THEN (s % 60) || 's' END) END AS duration,
      CASE id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE id % 3 <= 1 END AS closed, CASE WHEN id % 3 = 0 AND id <= 5000 THEN CAST(id AS DOUBLE) ELSE 2.5E0 END AS setting, id % 4 <> 1 AS switch,
      ROUND(100.0E0 * (id % 40) / 40, 1) AS pct, ROUND(CASE WHEN id % 40 > 0 THEN s * 1.0E0 / (id % 40) * (40 - id % 40) END, 4) AS eta FROM q"""


def x4_exif(spark, sf_dir):
    """Tags of every photo from both readers: the first has all of a third, nothing telling of another and only an ISO of the rest."""
    n = lambda k: F.pmod("id", F.lit(k))
    text = lambda c: c.cast("string")
    entries = lambda **tags: F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in tags.items())))
    shot = F.date_format("imported_at", "yyyy:MM:dd HH:mm:ss")
    whole = entries(**{"Image Model": F.lit("NIKON Z 6_3"), "EXIF DateTimeOriginal": F.when(n(4) > 0, shot).otherwise("0000:00:00 00:00:00"), "Image DateTime": shot, "EXIF FocalLength": F.concat(text(n(90) * 2), F.lit("/2")),
        "EXIF FNumber": F.lit("28/10"), "EXIF ExposureTime": F.concat(F.lit("1/"), text(n(5) * 100)), "EXIF ISOSpeedRatings": F.when(n(7) > 0, text(n(9) * 100)).otherwise("12.5"), "EXIF LensModel": F.lit(""), "MakerNote LensModel": F.lit(" 24-70 ")})
    bare = entries(**{"Image Model": F.lit(""), "EXIF DateTimeOriginal": F.lit("junk"), "EXIF FocalLength": F.lit("50"), "EXIF ISOSpeedRatings": F.lit("auto")})
    only = entries(**{"EXIF ISOSpeedRatings": F.lit(" 800 "), "EXIF FNumber": F.lit("a/b")})
    grouped = entries(**{"EXIF:Make": F.lit("FUJIFILM"), "Model": F.when(n(2) == 0, "X100VI").otherwise("Fujifilm X-T5"), "CreateDate": F.concat(shot, F.lit("+02:00")), "EXIF:FocalLength": text(n(70) + 0.5), "Composite:ApertureValue": F.lit("4.0"), "File:FNumber": F.lit("wide"),
        "ExposureTime": F.lit("0.004"), "EXIF:ISO": text(n(20) * 50 + 0.9), "MakerNotes:LensID": F.lit("XF 23"), "Lens": F.when(n(5) > 0, F.lit(" 35mm ")), "MakerNotes:FilmMode": F.when(n(3) == 1, F.lit("Velvia ")).otherwise(""), "PictureControlBase": F.lit("VIVID")})
    x = scalars.normalize_exif(F.when(n(3) == 0, whole).when(n(3) == 1, bare).otherwise(F.when(n(6) == 2, only).otherwise(bare)), F.when(n(11) > 0, grouped))
    rows = views.photos(spark, sf_dir).select("id", x.alias("x")).select("id", "x.*")
    return rows.withColumns({"shot_at": views.second_text("shot_at"), **{c: F.round(c, 6) for c in ("focal_length_mm", "aperture", "shutter_speed")}})


_X4 = """WITH q AS (SELECT id, STRFTIME(imported_at, '%Y-%m-%d %H:%M:%S') AS shot, id % 3 = 0 AS whole, id % 3 = 2 AND id % 6 = 2 AS bare_iso, id % 11 > 0 AS has FROM photos), r AS (SELECT *, NOT whole AND NOT bare_iso AND has AS g FROM q)
    SELECT id, CASE WHEN whole THEN 'Z6III' WHEN g AND id % 2 = 0 THEN 'FUJIFILM X100VI' WHEN g THEN 'Fujifilm X-T5' END AS camera, CASE WHEN whole AND id % 4 > 0 OR g THEN shot END AS shot_at,
      CASE WHEN whole THEN CAST(id % 90 AS DOUBLE) WHEN g THEN id % 70 + 0.5E0 WHEN NOT bare_iso THEN 50.0E0 END AS focal_length_mm, CASE WHEN whole THEN 2.8E0 END AS aperture,
      CASE WHEN whole THEN CASE WHEN id % 5 > 0 THEN ROUND(1.0E0 / (id % 5 * 100), 6) END WHEN g THEN 0.004E0 END AS shutter_speed,
      CAST(CASE WHEN whole THEN CASE WHEN id % 7 > 0 THEN id % 9 * 100 END WHEN bare_iso THEN 800 WHEN g THEN id % 20 * 50 END AS INT) AS iso,
      CASE WHEN whole THEN '24-70' WHEN g THEN CASE WHEN id % 5 > 0 THEN '35mm' ELSE 'XF 23' END END AS lens_model, CASE WHEN g THEN CASE WHEN id % 3 = 1 THEN 'Velvia' ELSE 'VIVID' END END AS film_simulation FROM r"""


def _events_batch(spark, sf_dir):
    """A row for every photo whose number isn't a multiple of 4 and, with a later place, one more for multiples of 6; multiples of 10 have no uuid."""
    p = views.photos(spark, sf_dir)
    rows = p.select(F.when(F.col("id") % 10 > 0, F.col("uuid")).alias("sample_uuid"), "id", F.lit("keep").alias("decision"), F.lit(1).alias("seq"), (F.col("id") % 3 == 0).alias("is_auto"))
    return rows.where("id % 4 > 0").unionByName(rows.where("id % 6 = 0").withColumns({"decision": F.lit("maybe"), "seq": F.lit(2), "is_auto": F.lit(False)}))


def _even_samples(spark, sf_dir):
    return views.photos(spark, sf_dir).where("id % 2 = 0").select(F.col("uuid").alias("sample_uuid"), F.lit("reject").alias("decision"))


def s7_upsert_log(spark, sf_dir):
    table = _table(_even_samples(spark, sf_dir), "sample_uuid")
    buckets.put_shooting_log(table, _events_batch(spark, sf_dir), "log", 1)
    return table.read()


def s9_upsert_samples(spark, sf_dir):
    table = _table(_even_samples(spark, sf_dir), "sample_uuid")
    for _ in range(2):
        buckets.put_training_samples(table, _events_batch(spark, sf_dir), "review", 1)
    return table.read()


def s10_undo(spark, sf_dir):
    """Both tables in one after the decisions of every photo that divides by 14 are undone."""
    p, decided = views.photos(spark, sf_dir), views.decisions(spark, sf_dir)
    d, s = catalog.undo_decisions(decided, _even_samples(spark, sf_dir), p.select("id", "uuid"), p.where("id % 14 = 0"))
    return d.select(F.col("image_id").cast("string").alias("key"), "decision").unionByName(s.select(F.col("sample_uuid").alias("key"), "decision"))


def s11_delete(spark, sf_dir):
    """What is left of each table when every third photo goes; bursts are of five photos, led by the first."""
    p = views.photos(spark, sf_dir)
    tables = {
        "images": p.select("id"),
        "decisions": views.decisions(spark, sf_dir).select("image_id"),
        "bursts": p.where("id % 5 = 0").select(F.col("id"), F.col("id").alias("hero_image_id")),
        "burst_members": p.select((F.col("id") - F.col("id") % 5).alias("burst_id"), F.col("id").alias("image_id")),
    }
    left = catalog.delete_images(tables, p.where("id % 3 = 0").select("id"))
    rows = [left[t].select(F.lit(t).alias("kind"), F.col(c).alias("id")) for t, c in (("images", "id"), ("decisions", "image_id"), ("bursts", "id"), ("burst_members", "image_id"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def s12_source_folder(spark, sf_dir):
    p = views.photos(spark, sf_dir).withColumn("source_folder", F.when(F.col("id") % 3 == 0, F.concat(F.lit("/own/"), "id")))
    return catalog.backfill_source_folder(p).select("id", "source_folder")


def s14_stale(spark, sf_dir):
    """Features with an iso become null there; every fifth text is broken, every seventh has no iso."""
    text = F.when(F.col("id") % 5 == 0, "{broken").when(F.col("id") % 7 == 0, '{"aperture":2.0}').otherwise('{"iso":100.0,"aperture":2.0}')
    rows = views.photos(spark, sf_dir).select("id", text.alias("features_json"), F.lit(5).alias("schema_version"))
    return catalog.null_stale_features(rows, ["iso"], 6)


def s15_stale_columns(spark, sf_dir):
    return catalog.null_stale_columns(views.photos(spark, sf_dir), ["iqa_score", "scene"]).select("id", "iqa_score", "scene", "iso")


def s18_subfolders(spark, sf_dir):
    """Below /shoot: a folder for each user, and decision folders that don't count."""
    p = views.photos(spark, sf_dir)
    files = p.select(F.col("file_path").alias("path")).unionByName(p.select(F.concat(F.lit("/shoot/_Keeps/"), "filename").alias("path"))).unionByName(p.select(F.concat(F.lit("/shoot/notes"), "id", F.lit("/x.txt")).alias("path")))
    return catalog.subfolder_photo_counts(files, "/shoot")


def s19_errors(spark, sf_dir):
    p = views.photos(spark, sf_dir)
    failed = p.where("id % 9 = 0").select("file_path")
    return catalog.error_rows(p.where("id % 2 = 0"), failed).groupBy("analysis_status").agg(F.count("*").alias("n"), F.count("id").alias("with_id"))


def _fives(spark, sf_dir):
    """Groups of five photos by number."""
    p = views.photos(spark, sf_dir)
    return groups.member_rows(p.select((F.col("id") - F.col("id") % 5).alias("group_id"), "id"), p)


def f6_matching_groups(spark, sf_dir):
    return browse.matching_groups(_fives(spark, sf_dir), browse.name_contains("7.jpg"))


def f8_histogram_backlog(spark, sf_dir):
    p = views.photos(spark, sf_dir).withColumns({"histogram_json": F.when(F.col("id") % 3 > 0, "[]"), "preview_path": F.when(F.col("id") % 2 == 0, F.col("file_path"))})
    return browse.histogram_backlog(p).select("id")


def j4_heroes(spark, sf_dir):
    """Every second group has a pick of its last member, every third one of a photo that is no member."""
    members = _fives(spark, sf_dir)
    keys = members.groupBy("group_id").agg(scalars.hero_key(F.collect_list("id")).alias("key"), F.max("id").alias("last"))
    picks = keys.where("group_id % 10 = 0").select("key", F.when(F.col("group_id") % 15 == 0, F.lit(-1).cast("long")).otherwise(F.col("last")).alias("hero"))
    return groups.group_hero(members, picks)


def j7_search_groups(spark, sf_dir):
    """Photos of sharpness 50 or more as hits, by groups of five of the even hundreds."""
    p = views.photos(spark, sf_dir)
    hits = p.where("sharpness_score >= 50").select("id", F.col("sharpness_score").alias("score"))
    return browse.search_groups(hits, _fives(spark, sf_dir).where("id % 200 < 100"))


def o3_rank_groups(spark, sf_dir):
    """Groups by the place of their first photo, those of every seventh missing."""
    p = views.photos(spark, sf_dir)
    places = p.where("id % 7 > 0").select("id", F.col("sharpness_score").alias("place"))
    heroes = p.where("id % 5 = 0").select(F.col("id").alias("group_id"), F.col("id").alias("hero"))
    return browse.rank_groups(heroes, places)


def a20_pending(spark, sf_dir):
    return dashboard.pending_reanalysis(views.photos(spark, sf_dir).withColumn("face_embedding", F.when(F.col("id") % 4 == 0, F.array(F.lit(1.0)))))


def a23_signals(spark, sf_dir):
    """The share of photos by camera and scene as if it were an importance."""
    p = views.photos(spark, sf_dir)
    shares = p.groupBy(F.concat_ws(" ", "camera", "scene").alias("feature")).agg(F.count("*").alias("n")).crossJoin(p.agg(F.count("*").alias("total"))).select("feature", (F.col("n") / F.col("total")).alias("importance"))
    return dashboard.learned_signals(shares, 0.1)


def g4_gate(spark, sf_dir):
    """Links of each photo with the next: faces of every fourth, scenes, histograms of every third."""
    p = views.photos(spark, sf_dir)
    turn = lambda n: F.array(F.cos(F.pmod("id", F.lit(n)) * 0.3), F.sin(F.pmod("id", F.lit(n)) * 0.3))
    meta = p.select("id", F.when(F.col("id") % 4 < 2, turn(9)).alias("face"), "scene", F.when(F.col("id") % 3 < 2, turn(5)).alias("hist"))
    links = p.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(p.select(F.col("id").alias("b")), "b")
    return similarity.gated(links.select("a", "b"), meta)


_GATE = """WITH m AS (SELECT id, scene, CASE WHEN id % 4 < 2 THEN (id % 9) * 0.3E0 END AS f, CASE WHEN id % 3 < 2 THEN (id % 5) * 0.3E0 END AS h FROM photos)
    SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON b.id = a.id + 1 WHERE CASE WHEN a.f IS NOT NULL AND b.f IS NOT NULL THEN COS(a.f - b.f) >= 0.5
      WHEN LEAST(a.scene, b.scene) || '|' || GREATEST(a.scene, b.scene) IN ('indoor|landscape', 'indoor|night', 'indoor|water', 'action|indoor', 'landscape|portrait', 'landscape|macro', 'macro|portrait', 'night|portrait', 'portrait|water', 'action|macro', 'macro|night', 'macro|water') THEN FALSE
      WHEN a.h IS NOT NULL AND b.h IS NOT NULL THEN COS(a.h - b.h) >= 0.9 ELSE TRUE END"""


def _leaders(members):
    """Within a group, photos of the same camera follow the first of it; all of every fourth group follow one."""
    return members.withColumn("leader_id", F.when(F.col("group_id") % 20 == 0, F.col("group_id")).when(F.col("id") % 5 == 3, F.col("id") - 1).otherwise(F.col("id"))).select("group_id", "id", "leader_id")


def g11_outcomes(spark, sf_dir):
    """The cache knows groups by number: as near-duplicates, or their leaders as ranked."""
    members = _fives(spark, sf_dir)
    full = groups.group_keys(members.where("group_id % 30 = 5")).select("members_hash", F.lit("near_duplicates").alias("outcome"))
    reps = groups.group_keys(_leaders(members).where("id = leader_id and group_id % 30 = 10")).select("members_hash", F.lit("ranked").alias("outcome"))
    return groups.ranking_outcome(members, _leaders(members), full.unionByName(reps)).groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(F.length("members_hash") == 40).alias("hashes"))


def g12_expanded(spark, sf_dir):
    """Leaders ranked from the last to the first."""
    leaders = _leaders(_fives(spark, sf_dir))
    n = leaders.where("id = leader_id").groupBy("group_id").agg(F.count("*").cast("int").alias("n"))
    ranks = n.select("group_id", F.transform(F.sequence(F.lit(1), "n"), lambda k: F.struct(k.alias("image_index"), (F.col("n") - k + 1).alias("rank"), F.concat(F.lit("r"), k).alias("reason"))).alias("rankings"))
    return groups.expand_rankings(ranks, leaders)


def g15_manual(spark, sf_dir):
    """Photos 1 to 3 become a group, 4 joins it, 5 and 6 stand alone, and 2 is cleared."""
    p = views.photos(spark, sf_dir).withColumn("manual_group_id", F.lit(None).cast("string"))
    for mode, ids, target in (("new_group", [1, 2, 3], None), ("join_group", [4], 1), ("singletons", [5, 6], None), ("clear", [2], None)):
        p = groups.set_manual_group(p, mode, ids, target)
    return p.select("id", "manual_group_id")


def g18_queue(spark, sf_dir):
    """The whole queue; photos of every ninth number have no personal score, and those of every thirteenth no overall one."""
    p = views.photos(spark, sf_dir).withColumns({"personal_score": F.when(F.col("id") % 9 > 0, F.col("overall_score")), "overall_score": F.when(F.col("id") % 13 > 0, F.col("overall_score"))})
    return groups.training_queue(p, views.decisions(spark, sf_dir))


#: Photos and gaps one after another, as the queue is walked; draws are the first 32 bits of an MD5.
_G18 = """WITH n AS (SELECT id, ROW_NUMBER() OVER (ORDER BY CASE WHEN id % 9 > 0 THEN LEAST(ABS(overall_score - 70), ABS(overall_score - 45)) END NULLS LAST, id) AS behind FROM photos WHERE analysis_status = 'done' AND id NOT IN (SELECT image_id FROM decisions)),
    c AS (SELECT COUNT(*) AS n FROM n), a AS (SELECT id, ROW_NUMBER() OVER (ORDER BY SUBSTR(MD5('42:again:' || id), 1, 8), id) - 1 AS k FROM photos WHERE id % 13 > 0 AND id IN (SELECT image_id FROM decisions)),
    g AS (SELECT k, SUM(5 + CAST('0x' || SUBSTR(MD5('42:gap:' || k), 1, 8) AS BIGINT) % 21) OVER (ORDER BY k) AS behind FROM a),
    q AS (SELECT id, CAST(behind AS BIGINT) AS behind, FALSE AS reshow FROM n UNION ALL SELECT a.id, CAST(g.behind AS BIGINT), TRUE FROM a JOIN g ON g.k = a.k, c WHERE g.behind <= c.n AND a.k < FLOOR(c.n * 0.3E0))
    SELECT ROW_NUMBER() OVER (ORDER BY behind, reshow) - 1 AS place, id, reshow FROM q"""


def d5_bulk(spark, sf_dir):
    """Even numbers up to twice the largest are asked for: known ones are kept, the others told."""
    p = views.photos(spark, sf_dir).select("id")
    asked = p.select((F.col("id") * 2).alias("id"))
    known, unknown = decide.bulk_decision(asked.unionByName(asked), "keep", p)
    return known.unionByName(unknown.select(F.col("id").alias("image_id"), F.lit("unknown").alias("decision")))


def _frames(spark, sf_dir):
    """Every document's bytes as a grey frame of 64 columns, padded with zeros."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    height = F.greatest(F.lit(1), F.ceil(F.length("bytes") / 64)).cast("int")
    body = F.concat(F.hex("bytes"), F.repeat(F.lit("00"), height * 64 - F.length("bytes")))
    image = F.struct(F.col("doc_id").cast("string").alias("origin"), height.alias("height"), F.lit(64).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.unhex(body).alias("data"))
    return docs.select("doc_id", image.alias("image"))


def p_frames(spark, sf_dir):
    """P2 to P4 of the frames."""
    rows = pixels.pixel_features(_frames(spark, sf_dir))
    x = F.col("pixels")
    tones = pixels.tonal_distribution(x["lum"])
    found = rows.select(
        "doc_id", x["width"].alias("width"), x["height"].alias("height"), F.round(x["mean"], 4).alias("mean"), F.round(x["std"], 4).alias("std"), F.round(x["shadow_pct"] * 64 * x["height"] / 100).cast("long").alias("black"),
        x["r"][32].alias("spaces"), F.round(tones["shadows"], 1).alias("shadows"), tones["kind"].alias("tones"),
    )
    with settings(spark, views.FRAMES):
        return written(found)


def p_measures(spark, sf_dir):
    """P1, P5, P6, P8 and P9 of the frames of 18 rows or more from one decoding, every second with a box of 32 by 16 pixels."""
    frames = _frames(spark, sf_dir).where("image.height >= 18")
    boxes = frames.where("doc_id % 2 = 0").select(F.col("image.origin").alias("origin"), F.lit(0).alias("face_index"), F.lit(8).alias("x0"), F.lit(2).alias("y0"), F.lit(40).alias("x1"), F.lit(18).alias("y1"))
    x = F.col("pixels")
    roots = ("p90_laplacian", "p90_tenengrad", "p90_mlap", "normalized_score", "consistency")
    found = pixels.pixel_features(pixels.with_boxes(frames, boxes)).select(
        "doc_id", *(F.round(F.sqrt(x[n]), 4).alias(f"{n}_root") for n in roots), *(F.round(x["hist64"][21 * k], 6).alias(f"hist_{k}") for k in range(4)),
        x["clip_lo"]["r"].alias("black_pct"), x["clip_lo"]["visible"].alias("dark_pct"), x["clip_hi"]["visible"].alias("light_pct"), x["faces"][0]["sharpness"].alias("face_sharpness"),
    )
    with settings(spark, views.FRAMES):
        return written(found)


#: Neighbours by their distance in the row of pixels; beyond an edge the one on the other side of it counts.
_MEASURES = """WITH b AS (SELECT doc_id, STRLEN(COALESCE(text, '')) AS n, CAST(CEIL(STRLEN(COALESCE(text, '')) / 64.0E0) AS BIGINT) AS h, HEX(ENCODE(COALESCE(text, ''))) AS x FROM documents WHERE STRLEN(COALESCE(text, '')) > 17 * 64),
    c AS (SELECT doc_id, h, k, k // 64 AS y, k % 64 AS x, CASE WHEN k < n THEN CAST('0x' || SUBSTR(hx, CAST(2 * k + 1 AS BIGINT), 2) AS INT) ELSE 0 END AS v FROM (SELECT doc_id, n, h, x AS hx, UNNEST(RANGE(64 * h)) AS k FROM b) t),
    o AS (SELECT *, LAG(v, 1) OVER w AS l, LEAD(v, 1) OVER w AS r, LAG(v, 64) OVER w AS u, LEAD(v, 64) OVER w AS d, LAG(v, 65) OVER w AS ul, LAG(v, 63) OVER w AS ur, LEAD(v, 63) OVER w AS dl, LEAD(v, 65) OVER w AS dr FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
    e AS (SELECT doc_id, h, y, x, v, CASE WHEN x = 0 THEN r ELSE l END AS l, CASE WHEN x = 63 THEN l ELSE r END AS r, CASE WHEN y = 0 THEN d ELSE u END AS u, CASE WHEN y = h - 1 THEN u ELSE d END AS d,
      CASE WHEN y = 0 AND x = 0 THEN dr WHEN y = 0 THEN dl WHEN x = 0 THEN ur ELSE ul END AS ul, CASE WHEN y = 0 AND x = 63 THEN dl WHEN y = 0 THEN dr WHEN x = 63 THEN ul ELSE ur END AS ur,
      CASE WHEN y = h - 1 AND x = 0 THEN ur WHEN y = h - 1 THEN ul WHEN x = 0 THEN dr ELSE dl END AS dl, CASE WHEN y = h - 1 AND x = 63 THEN ul WHEN y = h - 1 THEN ur WHEN x = 63 THEN dl ELSE dr END AS dr FROM o),
    g AS (SELECT doc_id, h, y, x, v, u + d + l + r - 4 * v AS lap, ur + 2 * r + dr - ul - 2 * l - dl AS gx, dl + 2 * d + dr - ul - 2 * u - ur AS gy, ABS(2 * v - l - r) + ABS(2 * v - u - d) AS ml FROM e),
    t AS (SELECT doc_id, VAR_POP(lap) AS a, AVG(gx * gx + gy * gy) AS b, AVG(ml) AS c FROM g WHERE y < h // 16 * 16 GROUP BY doc_id, y // (h // 16), x // 4),
    f AS (SELECT doc_id, QUANTILE_CONT(a, 0.9) AS a, QUANTILE_CONT(b, 0.9) AS b, QUANTILE_CONT(c, 0.9) AS c FROM t GROUP BY doc_id),
    q AS (SELECT doc_id, QUANTILE_CONT(SQRT(gx * gx + gy * gy), 0.8) AS q FROM g GROUP BY doc_id),
    s AS (SELECT g.doc_id, COUNT(*) AS n, AVG(COS(2 * ATAN2(ABS(gy), gx))) AS c, AVG(SIN(2 * ATAN2(ABS(gy), gx))) AS s FROM g JOIN q ON q.doc_id = g.doc_id WHERE SQRT(gx * gx + gy * gy) > q.q GROUP BY g.doc_id),
    k AS (SELECT doc_id, ROUND_EVEN(AVG(v), 0) AS v FROM (SELECT *, (GREATEST(h, 64) + 127) // 128 AS k FROM (SELECT doc_id, h, y, x, v FROM c) z) z2 WHERE y < h // k * k AND x < 64 // k * k GROUP BY doc_id, y // k, x // k),
    n AS (SELECT doc_id, COUNT(*) FILTER (WHERE v < 64) AS h0, COUNT(*) FILTER (WHERE v >= 64 AND v < 128) AS h1, COUNT(*) FILTER (WHERE v >= 128 AND v < 192) AS h2, COUNT(*) FILTER (WHERE v >= 192) AS h3 FROM k GROUP BY doc_id),
    m AS (SELECT doc_id, SQRT(1.0E0 * h0 * h0 + h1 * h1 + h2 * h2 + h3 * h3) AS size, * EXCLUDE (doc_id) FROM n),
    p AS (SELECT doc_id, ROUND_EVEN(100.0E0 * COUNT(*) FILTER (WHERE v = 0) / COUNT(*), 3) AS black_pct, ROUND_EVEN(100.0E0 * COUNT(*) FILTER (WHERE v <= 2) / COUNT(*), 3) AS dark_pct, ROUND_EVEN(100.0E0 * COUNT(*) FILTER (WHERE v >= 253) / COUNT(*), 3) AS light_pct FROM c GROUP BY doc_id),
    i AS (SELECT doc_id, y - 2 AS y, x - 8 AS x, v, LAG(v, 1) OVER w AS l, LEAD(v, 1) OVER w AS r, LAG(v, 32) OVER w AS u, LEAD(v, 32) OVER w AS d FROM c WHERE doc_id % 2 = 0 AND y >= 2 AND y < 18 AND x >= 8 AND x < 40 WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
    j AS (SELECT doc_id, ROUND(VAR_POP(CASE WHEN y = 0 THEN d ELSE u END + CASE WHEN y = 15 THEN u ELSE d END + CASE WHEN x = 0 THEN r ELSE l END + CASE WHEN x = 31 THEN l ELSE r END - 4 * v), 1) AS face_sharpness FROM i GROUP BY doc_id)
    SELECT f.doc_id, ROUND(SQRT(f.a), 4) AS p90_laplacian_root, ROUND(SQRT(f.b), 4) AS p90_tenengrad_root, ROUND(SQRT(f.c), 4) AS p90_mlap_root, ROUND(SQRT(CBRT(f.a / 12 * f.b / 1200 * f.c / 7)), 4) AS normalized_score_root, ROUND(CASE WHEN s.n >= 100 THEN SQRT(SQRT(s.c * s.c + s.s * s.s)) ELSE 0 END, 4) AS consistency_root,
      ROUND(h0 / size, 6) AS hist_0, ROUND(h1 / size, 6) AS hist_1, ROUND(h2 / size, 6) AS hist_2, ROUND(h3 / size, 6) AS hist_3, black_pct, dark_pct, light_pct, face_sharpness
    FROM f JOIN m ON m.doc_id = f.doc_id JOIN p ON p.doc_id = f.doc_id LEFT JOIN s ON s.doc_id = f.doc_id LEFT JOIN j ON j.doc_id = f.doc_id"""


def c18_fact_sheet(spark, sf_dir):
    return views.photos(spark, sf_dir).select("id", scores.fact_sheet().alias("text"))


def _c18_sql() -> str:
    number = lambda x, d: f"COALESCE(PRINTF('%.{d}f', ROUND_EVEN(CAST({x} AS DOUBLE), {d})), 'N/A')"
    line = lambda label, x, low, high: f"'  {label}: ' || {number(x, 1)} || ' (' || CASE WHEN {x} IS NULL THEN 'N/A' WHEN {x} >= {high} THEN 'good' WHEN {x} >= {low} THEN 'borderline' ELSE 'poor' END || ')'"
    parts = [
        "'Camera: ' || COALESCE(camera, 'unknown camera')",
        f"'Settings: ' || {number('focal_length_mm', 0)} || 'mm · f/' || {number('aperture', 1)} || ' · ' || CASE WHEN shutter_speed >= 1 THEN {number('shutter_speed', 0)} || 's' ELSE '1/' || CAST(ROUND_EVEN(1 / shutter_speed, 0) AS BIGINT) || 's' END || ' · ISO ' || COALESCE(CAST(iso AS VARCHAR), 'N/A')",
        "CHR(10) || 'Technical scores (0–100):'",
        line("Overall", "overall_score", 40, 70),
        line("Sharpness", "NULLIF(sharpness_score, 0)", 40, 70),
        line("Exposure", "NULLIF(exposure_score, 0)", 40, 70),
        f"CASE WHEN NULLIF(iqa_score, 0) IS NOT NULL THEN {line('Perceptual quality (TOPIQ)', 'iqa_score', 35, 55)} END",
        f"CASE WHEN aesthetic_score IS NOT NULL THEN {line('Aesthetic appeal (LAION)', 'aesthetic_score', 30, 50)} END",
        f"CASE WHEN face_detected = 1 THEN CHR(10) || 'Faces:' || CHR(10) || '  ' || face_count || ' face(s) detected' || CASE WHEN eyes_open IS NULL THEN '' WHEN eyes_open = 0 THEN ', eyes CLOSED' ELSE ', eyes open' END || ', face sharpness ' || {number('face_sharpness_score', 0)} ELSE CHR(10) || 'Faces: none detected' END",
        "CHR(10) || 'Write your 2–3 sentence narrative explanation now:'",
    ]
    return f"SELECT id, CONCAT_WS(CHR(10), {', '.join(parts)}) AS text FROM photos"


def p10_faces(spark, sf_dir):
    """P10 of two faces a photo in a frame of 100 by 80, the second of every third photo larger; and P11 by blinks, smiles and jaws of each."""
    p = views.photos(spark, sf_dir)
    x, y = F.pmod("id", F.lit(60)).cast("int"), F.pmod("id", F.lit(50)).cast("int")
    first = F.struct(F.lit(0).alias("face_index"), x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 20).alias("y1"))
    second = F.struct(F.lit(1).alias("face_index"), F.lit(40).alias("x0"), F.lit(30).alias("y0"), F.when(F.col("id") % 3 == 0, 75).otherwise(50).alias("x1"), F.lit(60).alias("y1"))
    boxes = p.select(F.col("id").cast("string").alias("origin"), F.explode(F.array(first, second)).alias("b")).select("origin", "b.*", F.lit(100).alias("width"), F.lit(80).alias("height"))
    geometry = pixels.face_geometry(boxes)
    strength = lambda n, k: F.pmod(F.col("id") * k + F.col("face_index"), F.lit(n)) / n
    shapes = F.map_from_arrays(F.array(*map(F.lit, ("eyeBlinkLeft", "eyeBlinkRight", "mouthSmileLeft", "mouthSmileRight", "jawOpen"))), F.array(strength(16, 3), strength(8, 5), strength(4, 1), strength(4, 3), strength(32, 7)))
    faces = boxes.join(p.select(F.col("id").cast("string").alias("origin"), "id"), "origin").select("origin", "face_index", F.when(F.col("id") % 11 > 0, shapes).otherwise(F.create_map().cast("map<string,double>")).alias("shapes"))
    return geometry.join(pixels.face_expression(faces, geometry), "origin")


_P10 = """WITH q AS (SELECT CAST(id AS VARCHAR) AS origin, id, id % 3 = 0 AS wide, id % 60 AS x, id % 50 AS y FROM photos),
    g AS (SELECT *, CAST(CASE WHEN wide THEN 1 ELSE 0 END AS INT) AS i, CASE WHEN wide THEN 37 ELSE GREATEST(0, x - 2) END AS a, CASE WHEN wide THEN 27 ELSE GREATEST(0, y - 2) END AS b, CASE WHEN wide THEN 78 ELSE LEAST(99, x + 22) END AS c, CASE WHEN wide THEN 63 ELSE LEAST(79, y + 22) END AS d FROM q),
    s AS (SELECT *, CASE WHEN id % 11 > 0 THEN ((id * 3 + i) % 16 / 16.0E0 + (id * 5 + i) % 8 / 8.0E0) / 2 ELSE 0 END AS blink, CASE WHEN id % 11 > 0 THEN ((id + i) % 4 / 4.0E0 + (id * 3 + i) % 4 / 4.0E0) / 2 ELSE 0 END AS smile, CASE WHEN id % 11 > 0 THEN (id * 7 + i) % 32 / 32.0E0 ELSE 0 END AS mouth,
      id % 11 = 0 OR ((id * 3) % 16 / 16.0E0 + (id * 5) % 8 / 8.0E0) / 2 < 0.4 AS open0, id % 11 = 0 OR ((id * 3 + 1) % 16 / 16.0E0 + (id * 5 + 1) % 8 / 8.0E0) / 2 < 0.4 AS open1 FROM g)
    SELECT origin, 2 AS face_count, i AS primary_index, ROUND_EVEN((c - a) * (d - b) / 8000.0E0, 4) AS face_size_ratio, ROUND_EVEN((a + c - 100) / 100.0E0, 3) AS offset_x, ROUND_EVEN((b + d - 80) / 80.0E0, 3) AS offset_y, a AS pad_x0, b AS pad_y0, c AS pad_x1, d AS pad_y1,
      ROUND_EVEN(1 - blink, 3) AS eye_openness_ratio, CAST(blink < 0.4 AS INT) AS eyes_open, ROUND_EVEN(smile, 3) AS smile_score, ROUND_EVEN(mouth, 3) AS mouth_open_score, '[' || CAST(open0 AS VARCHAR) || ',' || CAST(open1 AS VARCHAR) || ']' AS faces_eyes_open_json FROM s"""


def x13_rankings(spark, sf_dir):
    """Replies that rank two photos: plain, in a fence with words about it, with a rank twice, one short, and none."""
    row = lambda i, r: F.format_string('{"image_index": %d, "rank": %d, "reason": "r%d"}', F.lit(i), F.lit(r), F.col("id"))
    plain = F.concat(F.lit("["), row(1, 2), F.lit(", "), row(2, 1), F.lit("]"))
    replies = (plain, F.concat(F.lit("Here:\n```json\n"), plain, F.lit("\n```\nDone.")), F.concat(F.lit("["), row(1, 1), F.lit(", "), row(2, 1), F.lit("]")), F.concat(F.lit("["), row(1, 1), F.lit("]")), F.lit("sorry"))
    reply = F.element_at(F.array(*replies), (F.pmod("id", F.lit(5)) + 1).cast("int"))
    return views.photos(spark, sf_dir).select("id", F.explode_outer(scalars.parse_rankings(reply, F.lit(2))).alias("r")).select("id", "r.image_index", "r.rank", "r.reason")


_X13 = """SELECT id, i AS image_index, 3 - i AS rank, 'r' || id AS reason FROM photos, (VALUES (1), (2)) v(i) WHERE id % 5 < 2 UNION ALL SELECT id, NULL, NULL, NULL FROM photos WHERE id % 5 >= 2"""


_FRAMES = """WITH b AS (SELECT doc_id, STRLEN(COALESCE(text, '')) AS n, GREATEST(1, CAST(CEIL(STRLEN(COALESCE(text, '')) / 64.0E0) AS BIGINT)) AS h, HEX(ENCODE(COALESCE(text, ''))) AS x FROM documents),
    c AS (SELECT doc_id, CAST('0x' || SUBSTR(x, CAST(2 * k + 1 AS BIGINT), 2) AS INT) AS v FROM (SELECT doc_id, x, UNNEST(RANGE(n)) AS k FROM b WHERE n > 0) t),
    s AS (SELECT doc_id, SUM(v) AS s1, SUM(v * v) AS s2, COUNT(*) FILTER (WHERE v = 0) AS zeros, COUNT(*) FILTER (WHERE v = 32) AS spaces, COUNT(*) FILTER (WHERE v < 85) AS low, COUNT(*) FILTER (WHERE v >= 85 AND v < 170) AS mid, COUNT(*) FILTER (WHERE v >= 170) AS high FROM c GROUP BY doc_id),
    f AS (SELECT b.doc_id, b.h, 64.0E0 * b.h AS p, 64 * b.h - b.n AS pad, COALESCE(s1, 0) AS s1, COALESCE(s2, 0) AS s2, COALESCE(zeros, 0) AS zeros, COALESCE(spaces, 0) AS spaces, COALESCE(low, 0) AS low, COALESCE(mid, 0) AS mid, COALESCE(high, 0) AS high FROM b LEFT JOIN s ON s.doc_id = b.doc_id)
    SELECT doc_id, 64 AS width, CAST(h AS INT) AS height, ROUND(s1 / p, 4) AS mean, ROUND(SQRT(s2 / p - (s1 / p) * (s1 / p)), 4) AS std, CAST(zeros + pad AS BIGINT) AS black, CAST(spaces AS BIGINT) AS spaces,
      ROUND(100 * (low + pad) / p, 1) AS shadows, CASE WHEN 2 * mid > p THEN 'Balanced - Good midtone distribution' WHEN 2 * (low + pad) > p THEN 'Low-key - Predominantly dark tones' WHEN 2 * high > p THEN 'High-key - Predominantly bright tones' ELSE 'Mixed - Varied tonal distribution' END AS tones FROM f"""

_BATCH = """b AS (SELECT CASE WHEN id % 10 > 0 THEN uuid END AS u, CASE WHEN id % 6 = 0 THEN 'maybe' ELSE 'keep' END AS decision, id % 6 <> 0 AND id % 3 = 0 AS auto FROM photos WHERE id % 4 > 0 OR id % 6 = 0)"""
_UPSERT = "SELECT uuid AS sample_uuid, 'reject' AS decision FROM photos WHERE id % 2 = 0 AND uuid NOT IN (SELECT u FROM c) UNION ALL SELECT u, decision FROM c"
_LEADERS = "f AS (SELECT id - id % 5 AS group_id, id, CASE WHEN (id - id % 5) % 20 = 0 THEN id - id % 5 WHEN id % 5 = 3 THEN id - 1 ELSE id END AS leader_id FROM photos)"

QUERIES = {
    "c_labels": (c_labels, _LABELS),
    "x_texts": (x_texts, _TEXTS),
    "x4_exif": (x4_exif, _X4),
    "s7_upsert_log": (s7_upsert_log, f"WITH {_BATCH}, c AS (SELECT u, decision FROM b WHERE u IS NOT NULL) {_UPSERT}"),
    "s9_upsert_samples": (s9_upsert_samples, f"WITH {_BATCH}, c AS (SELECT u, decision FROM b WHERE u IS NOT NULL AND NOT auto) {_UPSERT}"),
    "s10_undo": (s10_undo, "SELECT CAST(image_id AS VARCHAR) AS key, decision FROM decisions WHERE image_id % 14 > 0 UNION ALL SELECT uuid, 'reject' FROM photos WHERE id % 2 = 0 AND id % 14 > 0"),
    "s11_delete": (
        s11_delete,
        """SELECT kind, COUNT(*) AS n, CAST(SUM(id) AS BIGINT) AS ids FROM (SELECT 'images' AS kind, id FROM photos WHERE id % 3 > 0 UNION ALL SELECT 'decisions', image_id FROM decisions WHERE image_id % 3 > 0
        UNION ALL SELECT 'bursts', id FROM photos WHERE id % 5 = 0 AND id % 3 > 0 UNION ALL SELECT 'burst_members', id FROM photos WHERE id % 3 > 0 AND (id - id % 5) NOT IN (SELECT id FROM photos WHERE id % 5 = 0 AND id % 3 = 0)) t GROUP BY kind""",
    ),
    "s12_source_folder": (s12_source_folder, "SELECT id, CASE WHEN id % 3 = 0 THEN '/own/' || id ELSE source_folder END AS source_folder FROM photos"),
    "s14_stale": (
        s14_stale,
        """SELECT id, CASE WHEN id % 5 = 0 THEN '{broken' WHEN id % 7 = 0 THEN '{"aperture":2.0}' ELSE '{"iso":null,"aperture":2.0}' END AS features_json, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 5 ELSE 6 END AS schema_version FROM photos""",
    ),
    "s15_stale_columns": (s15_stale_columns, "SELECT id, CAST(NULL AS DOUBLE) AS iqa_score, CAST(NULL AS VARCHAR) AS scene, iso FROM photos"),
    "s18_subfolders": (s18_subfolders, "SELECT COUNT(DISTINCT source_folder) AS subfolders FROM photos"),
    "s19_errors": (s19_errors, "SELECT CASE WHEN id % 9 = 0 THEN 'error' ELSE analysis_status END AS analysis_status, COUNT(*) AS n, COUNT(*) FILTER (WHERE id % 2 = 0) AS with_id FROM photos WHERE id % 2 = 0 OR id % 9 = 0 GROUP BY 1"),
    "f6_matching_groups": (f6_matching_groups, "SELECT id - id % 5 AS group_id, COUNT(*) FILTER (WHERE LOWER(filename) LIKE '%7.jpg%') AS matching_count, COUNT(*) AS total FROM photos GROUP BY 1 HAVING COUNT(*) FILTER (WHERE LOWER(filename) LIKE '%7.jpg%') > 0"),
    "f8_histogram_backlog": (f8_histogram_backlog, "SELECT id FROM photos WHERE id % 3 = 0 AND id % 2 = 0"),
    "j4_heroes": (
        j4_heroes,
        """WITH m AS (SELECT id - id % 5 AS g, id, ROW_NUMBER() OVER (PARTITION BY id - id % 5 ORDER BY overall_score DESC, id) AS n, COUNT(*) OVER (PARTITION BY id - id % 5) AS size, MAX(id) OVER (PARTITION BY id - id % 5) AS last FROM photos)
        SELECT g AS group_id, CASE WHEN g % 10 = 0 AND g % 15 > 0 THEN last ELSE id END AS hero, g % 10 = 0 AND g % 15 > 0 AS overridden, size FROM m WHERE n = 1""",
    ),
    "j7_search_groups": (
        j7_search_groups,
        """WITH h AS (SELECT CASE WHEN id % 200 < 100 THEN id - id % 5 END AS group_id, id, sharpness_score AS score FROM photos WHERE sharpness_score >= 50)
        SELECT group_id, score, id AS best_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY COALESCE(group_id, -1 - id) ORDER BY score DESC, id) AS n FROM h) t WHERE n = 1""",
    ),
    "o3_rank_groups": (o3_rank_groups, "SELECT id AS group_id, id AS hero, CASE WHEN id % 7 > 0 THEN sharpness_score END AS place FROM photos WHERE id % 5 = 0"),
    "a20_pending": (a20_pending, "SELECT COUNT(*) AS pending FROM photos WHERE face_detected = 1 AND analysis_status = 'done' AND id % 4 > 0"),
    "a23_signals": (
        a23_signals,
        """WITH s AS (SELECT CONCAT_WS(' ', camera, scene) AS feature, COUNT(*) * 1.0E0 / (SELECT COUNT(*) FROM photos) AS importance FROM photos GROUP BY 1)
        SELECT CASE WHEN importance >= 0.1 THEN feature ELSE 'other' END AS feature, ROUND(SUM(importance), 6) AS importance FROM s GROUP BY 1""",
    ),
    "g4_gate": (g4_gate, _GATE),
    "g11_outcomes": (
        g11_outcomes,
        f"""WITH {_LEADERS}, c AS (SELECT group_id, COUNT(*) AS size, COUNT(*) FILTER (WHERE id = leader_id) AS reps FROM f GROUP BY group_id)
        SELECT CASE WHEN size < 2 THEN 'too_few' WHEN group_id % 30 = 5 THEN 'near_duplicates_cached' WHEN reps < 2 THEN 'near_duplicates' WHEN group_id % 30 = 10 THEN 'ranked_cached' ELSE 'needs_ranking' END AS outcome, COUNT(*) AS n, COUNT(*) AS hashes FROM c GROUP BY 1""",
    ),
    "g12_expanded": (
        g12_expanded,
        f"""WITH {_LEADERS}, l AS (SELECT group_id, id, ROW_NUMBER() OVER (PARTITION BY group_id ORDER BY id) AS k, COUNT(*) OVER (PARTITION BY group_id) AS n FROM f WHERE id = leader_id)
        SELECT f.group_id, f.id, CAST(n - k + 1 AS INT) AS rank, CASE WHEN f.id = leader_id THEN 'r' || k ELSE 'near-duplicate of #' || (n - k + 1) END AS reason FROM f JOIN l ON l.group_id = f.group_id AND l.id = f.leader_id""",
    ),
    "g15_manual": (g15_manual, "SELECT id, CASE WHEN id IN (1, 3, 4) THEN SHA1('1,2,3') WHEN id IN (5, 6) THEN SHA1(CAST(id AS VARCHAR)) END AS manual_group_id FROM photos"),
    "g18_queue": (g18_queue, _G18),
    "d5_bulk": (d5_bulk, "SELECT 2 * id AS image_id, CASE WHEN 2 * id IN (SELECT id FROM photos) THEN 'keep' ELSE 'unknown' END AS decision FROM photos"),
    "p_frames": (p_frames, _FRAMES),
    "p_measures": (p_measures, _MEASURES),
    "c18_fact_sheet": (c18_fact_sheet, _c18_sql()),
    "p10_faces": (p10_faces, _P10),
    "x13_rankings": (x13_rankings, _X13),
}
