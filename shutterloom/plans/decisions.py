"""Queries on automatic decisions, filters, joins and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import Thresholds
from ..operators import browse, decide, learn
from ..storage import written
from . import views
from .dashboards import _samples

STRICT = Thresholds(iso_ceiling=12800.0, reject_reciprocal_rule=True, background_ceiling=0.65)

_D1 = """SELECT id, split_part(v, ':', 1) AS decision, split_part(v, ':', 2) AS reason FROM (SELECT id, CASE
      WHEN face_detected = 1 AND eyes_open = 0 THEN 'reject:closed_eyes'
      WHEN face_detected = 1 AND COALESCE(face_sharpness_score, 0) < 20 AND sharpness_score >= 40 THEN 'reject:soft_face'
      {strict}
      WHEN sharpness_score < 40 THEN 'reject:blurry_frame'
      WHEN overall_score >= 60 THEN 'keep:threshold_keep'
      WHEN overall_score >= 40 AND sharpness_score >= 60 THEN 'maybe:threshold_maybe'
      ELSE 'reject:threshold_reject' END AS v FROM {rows}) t"""
_STRICT = """WHEN iso > 12800 THEN 'reject:iso_ceiling'
      WHEN focal_length_mm > 0 AND shutter_speed > 1.0E0 / focal_length_mm THEN 'reject:reciprocal_rule'
      WHEN face_detected = 1 AND background_distraction_score >= 0.65 THEN 'reject:cluttered_background'"""


def _judged(thresholds):
    def run(spark, sf_dir):
        p = views.photos(spark, sf_dir)
        return p.select("id", decide.auto_decision(p.columns, thresholds).alias("v")).select("id", "v.decision", "v.reason")

    return run


def _cull(spark, sf_dir):
    photos = views.vector_photos(spark, sf_dir)
    return decide.auto_cull(photos, views.decisions(spark, sf_dir), threshold=0.25)


def d3_with_model(spark, sf_dir):
    """Culling by a model that has seen kept photos only, so that it moves every score up by all it may, and its ensemble, which agrees.

    Every eighth photo has no overall score, so the model says nothing of it.
    """
    photos = views.vector_photos(spark, sf_dir).withColumn("overall_score", F.when(F.col("id") % 8 > 0, F.col("overall_score")))
    corpus = written(learn.sample_weights(learn.training_corpus(_samples(spark, sf_dir).where("decision = 'keep'")), "2024-07-01 00:00:00"))
    scored = learn.with_personal(learn.train_personal(corpus, 2), learn.uncertainty_ensemble(corpus, 3, 2), photos)
    return decide.auto_cull(scored, views.decisions(spark, sf_dir), threshold=0.25, ready=True)


def d1_uncertain(spark, sf_dir):
    """Personal scores from 20 to 99 with spreads up to 11, by number; every sixth photo has none."""
    known = F.col("id") % 6 > 0
    p = views.photos(spark, sf_dir).withColumns({"personal_score": F.when(known, 20.0 + F.col("id") * 7 % 80), "personal_std": F.when(known, (F.col("id") % 12).cast("double"))})
    return p.select("id", decide.auto_decision(p.columns, ready=True).alias("v")).select("id", "v.decision", "v.reason")


_READY = """WHEN p_std >= 8 AND (ABS(p_score - 70) <= p_std OR ABS(p_score - 45) <= p_std) THEN 'maybe:uncertain'
      WHEN p_score >= 70 THEN 'keep:personal_keep' WHEN p_score >= 45 THEN 'maybe:personal_maybe' WHEN p_score IS NOT NULL THEN 'reject:personal_reject'"""


def d4_auto_cull_preview(spark, sf_dir):
    return decide.cull_summary(_cull(spark, sf_dir))


#: Groups of vectors in segments of 20 by components of cosine >= 0.25, and the culling on top of them.
_VECTOR_GROUPS = """u AS (SELECT p.*, v.embedding, v.shot_at AS v_at FROM photos p JOIN vectors v ON v.id = p.id WHERE analysis_status = 'done' AND p.id NOT IN (SELECT image_id FROM decisions)),
    seg AS (SELECT id, embedding, SUM(opens) OVER (ORDER BY v_at, id ROWS UNBOUNDED PRECEDING) AS segment FROM (SELECT id, embedding, v_at, CASE WHEN v_at - LAG(v_at) OVER (ORDER BY v_at, id) <= INTERVAL '60' SECOND THEN 0 ELSE 1 END AS opens FROM u) t),
    e AS (SELECT a.id AS x, b.id AS y FROM seg a JOIN seg b ON a.segment = b.segment AND a.id <> b.id WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.25),
    c(x, root) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.x),
    g AS (SELECT x AS id, MIN(root) AS group_id FROM c GROUP BY x)"""
_CULL = f"""{_VECTOR_GROUPS}, j AS ({_D1.format(strict='', rows='u')}),
    k AS (SELECT g.group_id, j.id, j.decision, j.reason, ROW_NUMBER() OVER (PARTITION BY g.group_id ORDER BY CASE WHEN face_detected = 1 THEN COALESCE(face_sharpness_score, 0) ELSE 0 END DESC, COALESCE(eyes_open, 0) DESC, sharpness_score DESC, COALESCE(iqa_score, 0) DESC, COALESCE(aesthetic_score, 0) DESC, overall_score DESC, j.id) AS n,
        COUNT(*) OVER (PARTITION BY g.group_id) AS size, BOOL_OR(j.decision = 'keep') OVER (PARTITION BY g.group_id) AS kept, BOOL_AND(j.reason IN ('iso_ceiling', 'reciprocal_rule', 'blurry_frame')) OVER (PARTITION BY g.group_id) AS physical
      FROM g JOIN j ON g.id = j.id JOIN u ON u.id = j.id),
    r AS (SELECT id FROM k WHERE n = 1 AND size >= 2 AND NOT kept AND NOT physical AND decision <> 'maybe'),
    f AS (SELECT j.id, CASE WHEN r.id IS NULL THEN j.decision ELSE 'maybe' END AS decision, j.reason, r.id IS NOT NULL AS promoted FROM j LEFT JOIN r ON r.id = j.id)"""

_CULL_READY = _CULL.replace("u AS (SELECT p.*,", "o AS (SELECT * REPLACE (CASE WHEN id % 8 > 0 THEN overall_score END AS overall_score) FROM photos), u AS (SELECT p.*, CASE WHEN p.overall_score IS NOT NULL THEN LEAST(100, p.overall_score + 25) END AS p_score, CASE WHEN p.overall_score IS NOT NULL THEN 0 END AS p_std,").replace("FROM photos p JOIN vectors", "FROM o p JOIN vectors")
_CULL_READY = _CULL_READY.replace(_D1.format(strict="", rows="u"), _D1.format(strict=_READY, rows="u")).replace("overall_score DESC, j.id", "COALESCE(overall_score, 0) DESC, j.id")

_PREVIEW = f"""WITH RECURSIVE {_CULL} SELECT COUNT(*) FILTER (WHERE decision = 'keep') AS keep, COUNT(*) FILTER (WHERE decision = 'maybe') AS maybe, COUNT(*) FILTER (WHERE decision = 'reject') AS reject,
    {", ".join(f"COUNT(*) FILTER (WHERE decision = 'reject' AND reason = '{r}') AS {r}" for r in decide.NAMED_REASONS)},
    COUNT(*) FILTER (WHERE decision = 'reject' AND reason NOT IN ({", ".join(f"'{r}'" for r in decide.NAMED_REASONS)})) AS low_score,
    COUNT(*) FILTER (WHERE reason = 'uncertain') AS uncertain, COUNT(*) FILTER (WHERE promoted) AS promotions FROM f"""


def f_filters(spark, sf_dir):
    """F1 to F5 as one condition each, counted."""
    rows = views.photos(spark, sf_dir).join(views.decisions(spark, sf_dir).withColumnRenamed("image_id", "id"), "id", "left")
    conditions = {
        "dates": browse.between_dates(F.col("shot_at"), "2024-01-03", "2024-01-09"),
        "portraits": browse.subject("portraits"),
        "landscape": browse.subject("landscape"),
        "groups": browse.subject("group"),
        "camera": F.col("camera") == "Z6III",
        "undecided": browse.decided_as("undecided"),
        "keep": browse.decided_as("keep"),
        "named": browse.name_contains("9.raf"),
    }
    return rows.agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def j1_catalog(spark, sf_dir):
    rows = browse.catalog(views.photos(spark, sf_dir), views.decisions(spark, sf_dir))
    return rows.select("id", "uuid", "source_folder", "decision", views.second_text("imported_at").alias("imported_at"), views.second_text("decided_at").alias("decided_at"))


def j2_trash(spark, sf_dir):
    return decide.trash_list(views.photos(spark, sf_dir), views.decisions(spark, sf_dir)).select("id", "file_path")


def j3_undecided(spark, sf_dir):
    return decide.undecided(views.photos(spark, sf_dir), views.decisions(spark, sf_dir)).select("id", "source_folder")


def o1_best_by_folder(spark, sf_dir):
    """The first three photos of every folder in the grid's order by perceptual score."""
    place = F.row_number().over(Window.partitionBy("source_folder").orderBy(*browse.photo_order("iqa_score")))
    return views.photos(spark, sf_dir).withColumn("place", place).where("place <= 3").select("source_folder", F.col("place").cast("long").alias("place"), "id", "iqa_score")


def o2_semantic_search(spark, sf_dir):
    """The query is the embedding of photo 7."""
    photos = views.vectors(spark, sf_dir)
    query = photos.where("id = 7").select("embedding").first()[0]
    return browse.semantic_search(photos, query, 50, 0.2)


QUERIES = {
    "d1_auto_decision": (_judged(Thresholds()), _D1.format(strict="", rows="photos")),
    "d1_auto_decision_strict": (_judged(STRICT), _D1.format(strict=_STRICT, rows="photos")),
    "d1_personal_rules": (d1_uncertain, f"WITH q AS (SELECT *, CASE WHEN id % 6 > 0 THEN 20.0E0 + id * 7 % 80 END AS p_score, CASE WHEN id % 6 > 0 THEN id % 12 END AS p_std FROM photos) {_D1.format(strict=_READY, rows='q')}"),
    "d3_auto_cull_with_model": (d3_with_model, f"WITH RECURSIVE {_CULL_READY} SELECT id, decision, reason, promoted FROM f"),
    "d3_auto_cull": (_cull, f"WITH RECURSIVE {_CULL} SELECT id, decision, reason, promoted FROM f"),
    "d4_auto_cull_preview": (d4_auto_cull_preview, _PREVIEW),
    "f_filters": (
        f_filters,
        """SELECT COUNT(*) FILTER (WHERE CAST(shot_at AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-09') AS dates, COUNT(*) FILTER (WHERE face_count >= 1) AS portraits, COUNT(*) FILTER (WHERE face_count = 0) AS landscape,
          COUNT(*) FILTER (WHERE face_count > 1) AS groups, COUNT(*) FILTER (WHERE camera = 'Z6III') AS camera, COUNT(*) FILTER (WHERE decision IS NULL AND analysis_status = 'done') AS undecided, COUNT(*) FILTER (WHERE decision = 'keep') AS keep,
          COUNT(*) FILTER (WHERE LOWER(filename) LIKE '%9.raf%') AS named FROM photos LEFT JOIN decisions ON id = image_id""",
    ),
    "j1_catalog": (j1_catalog, "SELECT id, uuid, source_folder, decision, STRFTIME(imported_at, '%Y-%m-%d %H:%M:%S') AS imported_at, STRFTIME(decided_at, '%Y-%m-%d %H:%M:%S') AS decided_at FROM photos LEFT JOIN decisions ON id = image_id"),
    "j2_trash": (j2_trash, "SELECT id, file_path FROM photos JOIN decisions ON id = image_id WHERE decision = 'reject'"),
    "j3_undecided": (j3_undecided, "SELECT id, source_folder FROM photos WHERE analysis_status = 'done' AND id NOT IN (SELECT image_id FROM decisions)"),
    "o1_best_by_folder": (o1_best_by_folder, "SELECT source_folder, place, id, iqa_score FROM (SELECT source_folder, id, iqa_score, ROW_NUMBER() OVER (PARTITION BY source_folder ORDER BY iqa_score DESC NULLS LAST, id) AS place FROM photos) t WHERE place <= 3"),
    "o2_semantic_search": (
        o2_semantic_search,
        """SELECT id, ROUND(d, 4) AS score FROM (SELECT v.id, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS d FROM vectors v, (SELECT embedding FROM vectors WHERE id = 7) q) t WHERE d >= 0.2 ORDER BY d DESC, id LIMIT 50""",
    ),
}
