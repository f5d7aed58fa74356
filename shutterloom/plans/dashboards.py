"""Queries on the shooting log, the decisions and the scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import APERTURE_CLASSES, FEATURES, FOCAL_CLASSES, ISO_CLASSES, SCENES
from ..functions import scalars, scores
from ..operators import bursts, dashboard, learn
from . import views


def _case(column: str, classes: tuple) -> str:
    cases = " ".join(f"WHEN {column} < {below} THEN {{}}" for below, _ in classes[:-1])
    label = cases.format(*(f"'{name}'" for _, name in classes[:-1]))
    place = cases.format(*range(len(classes) - 1))
    return f"CASE WHEN {column} IS NULL THEN 'Unknown' {label} ELSE '{classes[-1][1]}' END AS bucket, CASE WHEN {column} IS NULL THEN {len(classes)} {place} ELSE {len(classes) - 1} END AS place"


def _classes_sql(column: str, classes: tuple) -> str:
    return f"SELECT bucket, place, COUNT(*) AS count FROM (SELECT {_case(column, classes)} FROM photos) t GROUP BY bucket, place"


_WEEK = "STRFTIME({0}, '%Y-W%W')"
_MONTH = "STRFTIME({0}, '%Y-%m')"
_KMR = "COUNT(*) FILTER (WHERE decision = 'keep') AS keep, COUNT(*) FILTER (WHERE decision = 'maybe') AS maybe, COUNT(*) FILTER (WHERE decision = 'reject') AS reject"


def a1_cameras(spark, sf_dir):
    return dashboard.shooting_cameras(views.shooting_log(spark, sf_dir), "2024-01-01").withColumn("last_shot", views.second_text("last_shot"))


def a8_decisions(bucket):
    return lambda spark, sf_dir: dashboard.decisions_timeline(views.decisions(spark, sf_dir), bucket)


def _samples(spark, sf_dir):
    photos = views.photos(spark, sf_dir)
    rows = photos.join(views.decisions(spark, sf_dir).withColumnRenamed("image_id", "id"), "id")
    return rows.select(F.col("uuid").alias("sample_uuid"), "decision", "decided_at", "overall_score", learn.features_to_json(rows.columns).alias("features_json"))


def a10_signals(spark, sf_dir):
    flags = dashboard.signal_flags(dashboard.feature_deltas(_samples(spark, sf_dir)))
    return flags.withColumns({c: F.round(c, 4) for c in ("keep_median", "reject_median", "delta")})


def _feature_sql(name: str) -> str:
    if name == "face_present":
        return "CAST(face_detected AS DOUBLE)"
    if name.startswith("scene_is_"):
        return f"CASE WHEN scene = '{name.removeprefix('scene_is_')}' THEN 1.0E0 ELSE 0.0E0 END"
    known = ("sharpness_score", "exposure_score", "iqa_score", "aesthetic_score", "face_detected", "face_count", "face_sharpness_score", "eyes_open", "focal_length_mm", "aperture", "iso", "background_distraction_score")
    return f"CAST(CAST({name} AS FLOAT) AS DOUBLE)" if name in known else "CAST(NULL AS DOUBLE)"


def _a10_sql() -> str:
    section = {f: s for s, fs in dashboard.FEATURE_SECTIONS.items() for f in fs}
    one = [
        f"SELECT '{f}' AS feature, '{section.get(f, 'other')}' AS section, QUANTILE_CONT(x, 0.5) FILTER (WHERE decision = 'keep') AS k, QUANTILE_CONT(x, 0.5) FILTER (WHERE decision = 'reject') AS r, COUNT(x) FILTER (WHERE decision = 'keep') AS keep_n, COUNT(x) FILTER (WHERE decision = 'reject') AS reject_n FROM (SELECT decision, {_feature_sql(f)} AS x FROM s) q"
        for f in FEATURES
    ]
    return f"""WITH s AS (SELECT p.*, d.decision FROM photos p JOIN decisions d ON p.id = d.image_id), m AS ({" UNION ALL ".join(one)})
    SELECT feature, section, ROUND(k, 4) AS keep_median, ROUND(r, 4) AS reject_median, keep_n, reject_n, ROUND(k - r, 4) AS delta,
      (k IS NULL OR r IS NULL OR ABS(k - r) < 0.01 OR (ABS(k) < 0.01 AND ABS(r) < 0.01)) AS weak, LEAST(keep_n, reject_n) < 5 AS low_sample FROM m"""


def a11_totals(spark, sf_dir):
    return dashboard.decision_totals(dashboard.decisions_timeline(views.decisions(spark, sf_dir), "month"))


def a12_folders(spark, sf_dir):
    return dashboard.folders(views.photos(spark, sf_dir)).withColumn("last_import", views.second_text("last_import"))


def a13_counts(spark, sf_dir):
    return dashboard.decision_counts(views.photos(spark, sf_dir), views.decisions(spark, sf_dir))


def a14_session(spark, sf_dir):
    return dashboard.session_stats(views.photos(spark, sf_dir), views.decisions(spark, sf_dir))


def a15_cameras(spark, sf_dir):
    return dashboard.camera_list(views.photos(spark, sf_dir)).withColumn("newest", F.col("newest").cast("string"))


def _members(spark, sf_dir):
    runs = bursts.detect_bursts(views.photos(spark, sf_dir), 10.0)
    return runs.where("burst_id is not null").select(F.col("burst_id").alias("group_id"), "id")


def a16_composition(spark, sf_dir):
    return dashboard.group_composition(_members(spark, sf_dir), views.photos(spark, sf_dir), views.decisions(spark, sf_dir))


def runs_sql(gap: int) -> str:
    """Rows of photos with a time, with their run by gap: run, size of the run."""
    return f"""r0 AS (SELECT id, shot_at, sharpness_score, exposure_score, CASE WHEN LAG(shot_at) OVER (ORDER BY shot_at, id) IS NULL OR shot_at - LAG(shot_at) OVER (ORDER BY shot_at, id) > INTERVAL '{gap}' SECOND THEN 1 ELSE 0 END AS opens FROM photos WHERE shot_at IS NOT NULL),
    r1 AS (SELECT *, SUM(opens) OVER (ORDER BY shot_at, id ROWS UNBOUNDED PRECEDING) AS run FROM r0),
    r2 AS (SELECT *, COUNT(*) OVER (PARTITION BY run) AS size FROM r1),
    r3 AS (SELECT *, DENSE_RANK() OVER (ORDER BY run) AS burst_id FROM r2 WHERE size > 1)"""


_A16 = f"""WITH {runs_sql(10)} SELECT burst_id AS group_id, COUNT(*) AS size, {_KMR}, COUNT(decision) AS decided, COUNT(decision) = COUNT(*) AS all_decided,
    CASE WHEN COUNT(decision) = COUNT(*) AND MIN(decision) = MAX(decision) THEN MIN(decision) END AS unanimous,
    (BOOL_OR(p.format IN ('RAF', 'NEF')) AND BOOL_OR(p.format NOT IN ('RAF', 'NEF'))) AS mixed
    FROM r3 JOIN photos p ON p.id = r3.id LEFT JOIN decisions d ON d.image_id = r3.id GROUP BY burst_id"""


def a17_sharpness(spark, sf_dir):
    return dashboard.sharpness_summary(views.photos(spark, sf_dir))


def a18_calibration(spark, sf_dir):
    return dashboard.calibrate_sharpness(views.photos(spark, sf_dir))


def a19_burst_summary(spark, sf_dir):
    return bursts.burst_summary(bursts.detect_bursts(views.photos(spark, sf_dir)))


_A19 = f"""WITH {runs_sql(2)}, s AS (SELECT (SELECT COUNT(*) FROM photos) AS total, COUNT(DISTINCT burst_id) AS "groups", COUNT(*) AS burst_photos FROM r3)
    SELECT total, "groups", burst_photos, total - burst_photos AS singles, burst_photos - "groups" AS redundant, ROUND(100.0E0 * (burst_photos - "groups") / total, 1) AS reduction_pct FROM s"""


def a22_tallies(spark, sf_dir):
    return dashboard.pairwise_tallies(views.comparisons(spark, sf_dir)).withColumn("last_decided", views.second_text("last_decided"))


def a24_card(spark, sf_dir):
    return dashboard.model_card(_samples(spark, sf_dir), 120, True)


def c_scores(spark, sf_dir):
    """C1, C2, C4 to C7, C12, C13, C17, C18 on every photo; highlights and shadows stand in from ISO and aperture."""
    p = views.photos(spark, sf_dir)
    mean, hi, lo = F.col("sharpness_score") * 2, F.pmod("id", F.lit(25)).cast("double"), F.pmod("id", F.lit(12)).cast("double")
    return p.select(
        "id",
        scores.overall_score(F.col("sharpness_score"), F.col("exposure_score"), 0.6).alias("overall"),
        F.round(scores.piecewise_linear(hi, scores.CLIPPING_POINTS), 4).alias("clipping"),
        scores.exposure_warning(mean, hi, lo).alias("warning"),
        scores.exposure_intentional(mean, F.col("exposure_score")).alias("intentional"),
        scores.exif_risk(F.col("shutter_speed"), F.col("focal_length_mm"), F.col("iso"), F.col("camera")).alias("risk"),
        F.round(scores.burst_score(F.col("sharpness_score"), F.col("exposure_score")), 4).alias("burst"),
        scores.face_quality(F.col("face_detected"), F.col("face_sharpness_score"), F.col("eyes_open"), F.col("background_distraction_score")).alias("face"),
        F.round(scores.uncertainty(F.col("overall_score")), 4).alias("uncertainty"),
        scores.score_band(F.col("iqa_score"), 35, 55).alias("band"),
        scalars.format_shutter(F.col("shutter_speed")).alias("shutter"),
        scalars.hero_key(F.array("id", F.lit(7).cast("long"))).alias("hero_key"),
    )


_C = """WITH q AS (SELECT *, sharpness_score * 2 AS mean, CAST(id % 25 AS DOUBLE) AS hi, CAST(id % 12 AS DOUBLE) AS lo,
      CASE camera WHEN 'X100VI' THEN 16.0E0 WHEN 'Z6III' THEN 32.0E0 ELSE 1.0E0 END / focal_length_mm AS safe FROM photos),
    q2 AS (SELECT *, CASE WHEN focal_length_mm IS NULL THEN CASE WHEN shutter_speed < 1.0E0 / 60 THEN 'moderate' ELSE 'low' END WHEN shutter_speed <= safe THEN 'low' WHEN shutter_speed <= 2 * safe THEN 'moderate' ELSE 'high' END AS base FROM q)
    SELECT id, ROUND((3 * sharpness_score + 2 * exposure_score) / 5, 1) AS overall,
      ROUND(CASE WHEN hi <= 1 THEN 0.05E0 * hi WHEN hi <= 2 THEN 0.05E0 + (hi - 1) * 0.10E0 WHEN hi <= 5 THEN 0.15E0 + (hi - 2) * 0.10E0 WHEN hi <= 10 THEN 0.45E0 + (hi - 5) * 0.06E0 WHEN hi <= 20 THEN 0.75E0 + (hi - 10) * 0.025E0 ELSE 1.0E0 END, 4) AS clipping,
      CASE WHEN hi > 2 THEN 'clipped_highlights' WHEN lo > 5 THEN 'clipped_shadows' WHEN mean < 50 THEN 'dark' WHEN mean > 200 THEN 'bright' ELSE 'ok' END AS warning,
      ((mean < 80 AND exposure_score > 40) OR (mean > 200 AND exposure_score > 35)) AS intentional,
      CASE WHEN base = 'low' AND iso > 6400 THEN 'moderate' ELSE base END AS risk,
      ROUND(0.5E0 * sharpness_score + 0.3E0 * exposure_score + 20, 4) AS burst,
      CASE WHEN face_detected = 1 THEN GREATEST(0.0E0, LEAST(100.0E0, face_sharpness_score - CASE WHEN eyes_open = 0 THEN 35 ELSE 0 END + LEAST(10.0E0, 50 * background_distraction_score))) END AS face,
      ROUND(LEAST(ABS(overall_score - 70), ABS(overall_score - 45)), 4) AS uncertainty,
      CASE WHEN iqa_score IS NULL THEN 'N/A' WHEN iqa_score >= 55 THEN 'good' WHEN iqa_score >= 35 THEN 'borderline' ELSE 'poor' END AS band,
      CASE WHEN shutter_speed >= 1 THEN CONCAT(CAST(CAST(ROUND(shutter_speed) AS BIGINT) AS VARCHAR), 's') ELSE CONCAT('1/', CAST(CAST(ROUND(1 / shutter_speed) AS BIGINT) AS VARCHAR), 's') END AS shutter,
      CONCAT('hero:', CAST(LEAST(id, 7) AS VARCHAR), ',', CAST(GREATEST(id, 7) AS VARCHAR)) AS hero_key FROM q2"""


QUERIES = {
    "a1_shooting_cameras": (a1_cameras, "SELECT camera, COUNT(*) AS count, STRFTIME(MAX(shot_at), '%Y-%m-%d %H:%M:%S') AS last_shot FROM photos WHERE camera IS NOT NULL AND shot_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY camera"),
    "a2_focal_distribution": (lambda s, d: dashboard.focal_distribution(views.shooting_log(s, d)), _classes_sql("focal_length_mm", FOCAL_CLASSES)),
    "a3_aperture_distribution": (lambda s, d: dashboard.aperture_distribution(views.shooting_log(s, d)), _classes_sql("aperture", APERTURE_CLASSES)),
    "a4_iso_distribution": (lambda s, d: dashboard.iso_distribution(views.shooting_log(s, d)), _classes_sql("iso", ISO_CLASSES)),
    "a5_film_distribution": (lambda s, d: dashboard.named_distribution(views.shooting_log(s, d), "film_simulation"), "SELECT COALESCE(film_simulation, 'Unknown') AS film_simulation, COUNT(*) AS count FROM photos GROUP BY 1"),
    "a6_lens_distribution": (lambda s, d: dashboard.named_distribution(views.shooting_log(s, d), "lens_model"), "SELECT COALESCE(lens_model, 'Unknown') AS lens_model, COUNT(*) AS count FROM photos GROUP BY 1"),
    "a7_shooting_weeks": (lambda s, d: dashboard.shooting_timeline(views.shooting_log(s, d), "week"), f"SELECT {_WEEK.format('shot_at')} AS period, COUNT(*) AS count FROM photos WHERE shot_at IS NOT NULL GROUP BY 1"),
    "a7_shooting_months": (lambda s, d: dashboard.shooting_timeline(views.shooting_log(s, d), "month"), f"SELECT {_MONTH.format('shot_at')} AS period, COUNT(*) AS count FROM photos WHERE shot_at IS NOT NULL GROUP BY 1"),
    "a8_decision_weeks": (a8_decisions("week"), f"SELECT {_WEEK.format('decided_at')} AS period, {_KMR} FROM decisions GROUP BY 1"),
    "a8_decision_months": (a8_decisions("month"), f"SELECT {_MONTH.format('decided_at')} AS period, {_KMR} FROM decisions GROUP BY 1"),
    "a10_feature_signals": (a10_signals, _a10_sql()),
    "a11_decision_totals": (
        a11_totals,
        f"""WITH m AS (SELECT {_MONTH.format('decided_at')} AS period, {_KMR} FROM decisions GROUP BY 1)
        SELECT CAST(SUM(keep) AS BIGINT) AS keep, CAST(SUM(maybe) AS BIGINT) AS maybe, CAST(SUM(reject) AS BIGINT) AS reject, CAST(SUM(keep + maybe + reject) AS BIGINT) AS total, MAX(keep + maybe + reject) AS busiest_count,
          (SELECT period FROM m ORDER BY keep + maybe + reject DESC, period LIMIT 1) AS busiest, ROUND(SUM(keep) * 1.0E0 / SUM(keep + maybe + reject), 4) AS keep_rate FROM m""",
    ),
    "a12_folders": (a12_folders, "SELECT source_folder, COUNT(*) AS count, STRFTIME(MAX(imported_at), '%Y-%m-%d %H:%M:%S') AS last_import FROM photos GROUP BY source_folder"),
    "a13_decision_counts": (a13_counts, f"SELECT COUNT(*) AS \"all\", COUNT(*) FILTER (WHERE decision IS NULL AND analysis_status = 'done') AS undecided, {_KMR} FROM photos LEFT JOIN decisions ON id = image_id"),
    "a14_session_stats": (
        a14_session,
        """SELECT ROUND(AVG(overall_score) FILTER (WHERE decision = 'keep'), 4) AS kept_average, CAST(SUM(face_count) AS BIGINT) AS faces, COUNT(DISTINCT camera) AS cameras,
          (SELECT overall_score FROM (SELECT overall_score, ROW_NUMBER() OVER (ORDER BY overall_score) AS n, COUNT(*) OVER () AS c FROM photos) t WHERE n = FLOOR(c / 2) + 1) AS upper_median,
          (SELECT id FROM photos ORDER BY overall_score DESC, id LIMIT 1) AS top_image, MAX(overall_score) AS top_score FROM photos LEFT JOIN decisions ON id = image_id""",
    ),
    "a15_camera_list": (a15_cameras, "SELECT camera, CAST(CAST(MAX(shot_at) AS DATE) AS VARCHAR) AS newest FROM photos WHERE camera IS NOT NULL GROUP BY camera"),
    "a16_group_composition": (a16_composition, _A16),
    "a17_sharpness_summary": (
        a17_sharpness,
        """SELECT COUNT(sharpness_score) AS n, COUNT(*) FILTER (WHERE sharpness_score >= 70) AS sharp, COUNT(*) FILTER (WHERE sharpness_score < 40) AS blurry,
          ROUND(100.0E0 * COUNT(*) FILTER (WHERE sharpness_score >= 70) / COUNT(*), 2) AS sharp_pct, ROUND(100.0E0 * COUNT(*) FILTER (WHERE sharpness_score < 40) / COUNT(*), 2) AS blurry_pct,
          ROUND(AVG(sharpness_score), 4) AS mean, QUANTILE_CONT(sharpness_score, 0.5) AS median, MIN(sharpness_score) AS min, MAX(sharpness_score) AS max, ROUND(STDDEV_POP(sharpness_score), 4) AS std FROM photos""",
    ),
    "a18_sharpness_calibration": (
        a18_calibration,
        """WITH q AS (SELECT MIN(sharpness_score) AS min, QUANTILE_CONT(sharpness_score, 0.05) AS p5, QUANTILE_CONT(sharpness_score, 0.25) AS p25, QUANTILE_CONT(sharpness_score, 0.5) AS median, QUANTILE_CONT(sharpness_score, 0.75) AS p75, ROUND(AVG(sharpness_score), 4) AS mean, MAX(sharpness_score) AS max FROM photos)
        SELECT q.*, ROUND(p5 * 0.8E0, 1) AS suggested, (SELECT COUNT(*) FROM photos WHERE sharpness_score < 40) AS rejects_now, (SELECT COUNT(*) FROM photos, q q2 WHERE sharpness_score < ROUND(q2.p5 * 0.8E0, 1)) AS rejects_suggested FROM q""",
    ),
    "a19_burst_summary": (a19_burst_summary, _A19),
    "a22_pairwise_tallies": (
        a22_tallies,
        """SELECT id, CAST(SUM(won) AS BIGINT) AS wins, CAST(SUM(1 - won) AS BIGINT) AS losses, STRFTIME(MAX(decided_at), '%Y-%m-%d %H:%M:%S') AS last_decided
          FROM (SELECT winner_id AS id, 1 AS won, decided_at FROM comparisons UNION ALL SELECT loser_id, 0, decided_at FROM comparisons) t GROUP BY id""",
    ),
    "a24_model_card": (a24_card, "SELECT COUNT(*) AS decided, GREATEST(0, COUNT(*) - 120) AS pending, CASE WHEN COUNT(*) < 50 THEN 'learning' ELSE 'ready' END AS status FROM decisions JOIN photos ON id = image_id"),
    "c_scores": (c_scores, _C),
}
assert len(SCENES) == 8
