"""Queries on bursts, look-alike groups and their ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bursts, groups, similarity
from ..storage import written
from . import views
from .dashboards import runs_sql

_HERO = "FIRST_VALUE(id) OVER (PARTITION BY run ORDER BY 0.5E0 * sharpness_score + 0.3E0 * exposure_score + 20 DESC, shot_at, id)"


def g1_bursts(gap, by=()):
    return lambda spark, sf_dir: bursts.detect_bursts(views.photos(spark, sf_dir), gap, by).withColumn("score", F.round("score", 1)).withColumn("duration", F.round("duration", 3))


def _g1_sql(gap: int) -> str:
    return f"""WITH {runs_sql(gap)}, b AS (SELECT id, burst_id, size, {_HERO} AS hero, EPOCH(MAX(shot_at) OVER (PARTITION BY run)) - EPOCH(MIN(shot_at) OVER (PARTITION BY run)) AS duration FROM r3)
    SELECT p.id, b.burst_id, CASE WHEN b.burst_id IS NULL THEN 'single' WHEN b.hero = p.id THEN 'hero' ELSE 'burst_alternative' END AS role,
      ROUND((5 * p.sharpness_score + 3 * p.exposure_score + 200) / 10, 1) AS score, COALESCE(b.size, 1) AS size, ROUND(COALESCE(b.duration, 0), 3) AS duration FROM photos p LEFT JOIN b ON b.id = p.id"""


def g2_segments(spark, sf_dir):
    return bursts.time_segments(views.photos(spark, sf_dir).select("id", "shot_at"), 60.0).groupBy("segment").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_G2 = f"""WITH {runs_sql(60)} SELECT CAST(run AS BIGINT) AS segment, COUNT(*) AS n, MIN(id) AS first_id FROM r2 GROUP BY run
    UNION ALL SELECT 0, COUNT(*), MIN(id) FROM photos WHERE shot_at IS NULL HAVING COUNT(*) > 0"""

_GROUPS = """seg AS (SELECT id, embedding, CAST(FLOOR(id / 20) AS BIGINT) AS segment FROM vectors),
    e AS (SELECT a.id AS x, b.id AS y FROM seg a JOIN seg b ON a.segment = b.segment AND a.id <> b.id WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.25),
    c(x, root) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.x),
    g AS (SELECT x AS id, MIN(root) AS group_id FROM c GROUP BY x)"""


def _vector_groups(spark, sf_dir):
    return similarity.group_by_similarity(views.vectors(spark, sf_dir), 0.25, 60.0)


def _members(spark, sf_dir):
    """Bursts of 10 seconds with the photos' columns; written, as several steps read them."""
    photos = views.photos(spark, sf_dir)
    runs = bursts.detect_bursts(photos, 10.0).where("burst_id is not null").select(F.col("burst_id").alias("group_id"), "id")
    return written(groups.member_rows(runs, photos))


_BURSTS = f"{runs_sql(10)}, m AS (SELECT r3.burst_id AS group_id, p.*, ROW_NUMBER() OVER (PARTITION BY r3.burst_id ORDER BY p.id) AS pos FROM r3 JOIN photos p ON p.id = r3.id)"


def g6_heroes(spark, sf_dir):
    return groups.group_hero(_members(spark, sf_dir))


def g7_reasons(spark, sf_dir):
    members = _members(spark, sf_dir)
    return groups.best_reason(members, groups.group_hero(members))


_G7 = f"""WITH {_BURSTS}, h AS (SELECT *, FIRST_VALUE(id) OVER (PARTITION BY group_id ORDER BY overall_score DESC, pos) AS hero FROM m),
    o AS (SELECT group_id, COUNT(*) AS n, MAX(CASE WHEN face_detected = 1 THEN COALESCE(face_sharpness_score, 0) END) AS fs, AVG(CASE WHEN face_detected = 1 THEN COALESCE(face_sharpness_score, 0) END) AS fs_avg, COALESCE(BOOL_OR(eyes_open = 0), FALSE) AS blink,
      MAX(sharpness_score) AS sh, AVG(sharpness_score) AS sh_avg, MAX(iqa_score) AS iqa, MAX(aesthetic_score) AS aes FROM h WHERE id <> hero GROUP BY group_id)
    SELECT h.group_id, h.hero, CASE WHEN h.face_detected = 1 AND h.face_sharpness_score > 0 AND (o.fs IS NULL OR h.face_sharpness_score > o.fs) THEN 'Sharpest face (' || CAST(CAST(FLOOR(h.face_sharpness_score) AS BIGINT) AS VARCHAR) || ' vs avg ' || CAST(CAST(FLOOR(COALESCE(o.fs_avg, 0)) AS BIGINT) AS VARCHAR) || ')'
      WHEN h.face_detected = 1 AND h.eyes_open = 1 AND o.blink THEN 'Eyes open — others blinked'
      WHEN h.sharpness_score > 0 AND h.sharpness_score > o.sh THEN 'Sharpest frame (' || CAST(CAST(FLOOR(h.sharpness_score) AS BIGINT) AS VARCHAR) || ' vs avg ' || CAST(CAST(FLOOR(o.sh_avg) AS BIGINT) AS VARCHAR) || ')'
      WHEN h.iqa_score > o.iqa THEN 'Best perceptual quality (TOPIQ)' WHEN h.aesthetic_score > o.aes THEN 'Best aesthetic score' ELSE 'Highest overall score' END AS reason
    FROM h JOIN o ON o.group_id = h.group_id WHERE h.id = h.hero"""


def g9_candidates(spark, sf_dir):
    return groups.top_n_candidates(_members(spark, sf_dir), 2).select("group_id", "id", F.col("rank").cast("long").alias("rank"))


_G9 = f"""WITH {_BURSTS}, k AS (SELECT group_id, id, CASE WHEN COUNT(*) OVER (PARTITION BY group_id) <= 2 THEN pos ELSE ROW_NUMBER() OVER (PARTITION BY group_id ORDER BY CASE WHEN face_detected = 1 THEN COALESCE(face_sharpness_score, 0) ELSE 0 END DESC, COALESCE(eyes_open, 0) DESC, sharpness_score DESC, COALESCE(iqa_score, 0) DESC, COALESCE(aesthetic_score, 0) DESC, overall_score DESC, pos) END AS rank FROM m)
    SELECT group_id, id, rank FROM k WHERE rank <= 2"""


def g10_near_duplicates(spark, sf_dir):
    """Leaders within the look-alike groups at a cosine of 0.3."""
    members = groups.member_rows(_vector_groups(spark, sf_dir), views.vectors(spark, sf_dir))
    return similarity.collapse_near_duplicates(members, 0.3)


#: Photos of a group one after another: each goes to the first leader so far that is as similar, or leads itself.
_G10 = f"""WITH RECURSIVE {_GROUPS}, m AS (SELECT g.group_id, v.id, v.embedding, ROW_NUMBER() OVER (PARTITION BY g.group_id ORDER BY v.id) AS k FROM g JOIN vectors v ON v.id = g.id),
    n AS (SELECT a.group_id, a.k, a.id, COALESCE(LIST(b.id) FILTER (WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3), []) AS near FROM m a JOIN m b ON b.group_id = a.group_id GROUP BY ALL),
    s AS (SELECT DISTINCT group_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS leader_id, CAST([] AS BIGINT[]) AS leaders FROM n
      UNION ALL SELECT group_id, k, id, leader_id, CASE WHEN leader_id = id THEN LIST_APPEND(leaders, id) ELSE leaders END FROM
        (SELECT s.group_id, n.k, n.id, s.leaders, COALESCE(LIST_FILTER(s.leaders, lambda x: LIST_CONTAINS(n.near, x))[1], n.id) AS leader_id FROM s JOIN n ON n.group_id = s.group_id AND n.k = s.k + 1) z)
    SELECT group_id, id, leader_id FROM s WHERE id IS NOT NULL"""


def g13_prerank_state(spark, sf_dir):
    """Every fifth burst is ranked already, and every seventh found to be near-duplicates."""
    members = _members(spark, sf_dir)
    keys = groups.group_keys(members)
    outcome = F.when(F.col("group_id") % 5 == 0, "ranked").when(F.col("group_id") % 7 == 0, "near_duplicates")
    cache = keys.select("members_hash", outcome.alias("outcome")).where("outcome is not null")
    return groups.prerank_state(members, cache)


_G13 = f"""WITH {_BURSTS} SELECT group_id, COUNT(*) AS size, CASE WHEN COUNT(*) < 3 THEN 'not_applicable' WHEN group_id % 5 = 0 THEN 'ready' WHEN group_id % 7 = 0 THEN 'near_duplicates' ELSE 'pending' END AS state FROM m GROUP BY group_id"""


def g14_queue(spark, sf_dir):
    return groups.prerank_queue(_members(spark, sf_dir), 20, 2)


def g16_grid(spark, sf_dir):
    members = _members(spark, sf_dir)
    photos = views.photos(spark, sf_dir).select("id", F.col("id").alias("place"))
    return groups.grid_items(photos, members)


_G16 = f"""WITH {_BURSTS} SELECT m.group_id, MIN(p.id) AS place, MIN(p.id) AS first_id, COUNT(*) AS size FROM photos p LEFT JOIN m ON m.id = p.id GROUP BY m.group_id, CASE WHEN m.group_id IS NULL THEN p.id END"""


def g17_pairs(spark, sf_dir):
    """Pairs of done, undecided photos by overall score, without those compared before."""
    photos = views.photos(spark, sf_dir)
    open_rows = photos.where("analysis_status = 'done'").join(views.decisions(spark, sf_dir).select(F.col("image_id").alias("id")), "id", "left_anti")
    return groups.compare_pairs(open_rows.select("id", F.col("overall_score").alias("score")), views.comparisons(spark, sf_dir), 50)


_G17 = """WITH o AS (SELECT id, LEAST(ABS(s - 70), ABS(s - 45)) AS u FROM (SELECT id, CASE WHEN overall_score = 0 THEN 50.0E0 ELSE overall_score END AS s FROM photos WHERE analysis_status = 'done' AND id NOT IN (SELECT image_id FROM decisions)) t),
    n AS (SELECT id, ROW_NUMBER() OVER (ORDER BY u, id) - 1 AS at FROM o), q AS (SELECT a.at // 2 AS pos, a.id AS left_id, b.id AS right_id FROM n a JOIN n b ON b.at = a.at + 1 WHERE a.at % 2 = 0)
    SELECT CAST(pos AS BIGINT) AS pos, left_id, right_id FROM q WHERE NOT EXISTS (SELECT 1 FROM comparisons c WHERE LEAST(c.winner_id, c.loser_id) = LEAST(left_id, right_id) AND GREATEST(c.winner_id, c.loser_id) = GREATEST(left_id, right_id)) ORDER BY pos LIMIT 50"""


def g19_picks(spark, sf_dir):
    members = _members(spark, sf_dir)
    return groups.burst_pick_batch(members, groups.group_hero(members))


def x9_hashes(spark, sf_dir):
    return groups.group_keys(_members(spark, sf_dir)).select("group_id", "members_hash", "size")


QUERIES = {
    "g1_bursts": (g1_bursts(2.0), _g1_sql(2)),
    "g1_bursts_10s": (g1_bursts(10.0), _g1_sql(10)),
    "g2_time_segments": (g2_segments, _G2),
    "g3_similarity_groups": (_vector_groups, f"WITH RECURSIVE {_GROUPS} SELECT group_id, id FROM g"),
    "g6_heroes": (g6_heroes, f"WITH {_BURSTS} SELECT DISTINCT group_id, FIRST_VALUE(id) OVER (PARTITION BY group_id ORDER BY overall_score DESC, pos) AS hero, FALSE AS overridden, COUNT(*) OVER (PARTITION BY group_id) AS size FROM m"),
    "g7_best_reasons": (g7_reasons, _G7),
    "g9_top_candidates": (g9_candidates, _G9),
    "g10_near_duplicates": (g10_near_duplicates, _G10),
    "g13_prerank_state": (g13_prerank_state, _G13),
    "g14_prerank_queue": (g14_queue, f"WITH {_BURSTS} SELECT group_id, COUNT(*) AS size FROM m GROUP BY group_id HAVING COUNT(*) >= 2 ORDER BY size DESC, group_id LIMIT 20"),
    "g16_grid_items": (g16_grid, _G16),
    "g17_compare_pairs": (g17_pairs, _G17),
    "g19_burst_picks": (g19_picks, f"WITH {_BURSTS} SELECT id, CASE WHEN id = FIRST_VALUE(id) OVER (PARTITION BY group_id ORDER BY overall_score DESC, pos) THEN 'keep' ELSE 'reject' END AS decision FROM m"),
    "x9_members_hash": (x9_hashes, f"WITH {_BURSTS} SELECT group_id, sha1(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS members_hash, COUNT(*) AS size FROM m GROUP BY group_id"),
}
