import re
import math
import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.config import Thresholds
from shutterloom.operators import browse, bursts, decide, groups, ranks, similarity

MEMBER = "group_id long, id long, pos int, face_detected int, face_sharpness_score double, eyes_open int, sharpness_score double, iqa_score double, aesthetic_score double, overall_score double, decision string, reason string"


def member(i, group=1, face=0, fs=None, eyes=None, sh=50.0, iqa=None, aes=None, overall=50.0, decision=None, reason=None):
    return (group, i, i, face, fs, eyes, sh, iqa, aes, overall, decision, reason)


def judge(spark, t=Thresholds(), ready=False, **row):
    base = {"sharpness_score": 70.0, "overall_score": 70.0, "face_detected": 0, "face_count": 0}
    frame = spark.createDataFrame([tuple((base | row).values())], " , ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in (base | row).items()))
    v = frame.select(decide.auto_decision(frame.columns, t, ready).alias("v")).first().v
    return v.decision, v.reason


@pytest.mark.parametrize(
    "row,t,ready,want",
    [
        ({}, {}, False, ("keep", "threshold_keep")),
        ({"face_detected": 1, "eyes_open": 0, "face_count": 1}, {}, False, ("reject", "closed_eyes")),
        ({"face_detected": 1, "eyes_open": 0, "face_count": 3, "face_sharpness_score": 60.0}, {"closed_eyes_all_faces": True}, False, ("keep", "threshold_keep")),
        ({"face_detected": 1, "eyes_open": 0, "face_count": 2, "faces_eyes_open_json": "[false,false]", "face_sharpness_score": 60.0}, {"closed_eyes_all_faces": True}, False, ("reject", "closed_eyes")),
        ({"face_detected": 1, "eyes_open": 1, "face_count": 1}, {}, False, ("reject", "soft_face")),
        ({"iso": 20000}, {"iso_ceiling": 12800.0}, False, ("reject", "iso_ceiling")),
        ({"focal_length_mm": 50.0, "shutter_speed": 0.1}, {"reject_reciprocal_rule": True}, False, ("reject", "reciprocal_rule")),
        ({"focal_length_mm": 0.0, "shutter_speed": 0.1}, {"reject_reciprocal_rule": True}, False, ("keep", "threshold_keep")),
        ({"focal_length_mm": 50.0, "shutter_speed": "1/40"}, {"reject_reciprocal_rule": True}, False, ("reject", "reciprocal_rule")),
        ({"focal_length_mm": 50.0, "shutter_speed": "1/250"}, {"reject_reciprocal_rule": True}, False, ("keep", "threshold_keep")),
        ({"focal_length_mm": 50.0, "shutter_speed": "fast"}, {"reject_reciprocal_rule": True}, False, ("keep", "threshold_keep")),
        ({"face_detected": 1, "face_sharpness_score": 50.0, "eyes_open": 1, "background_distraction_score": 0.65}, {"background_ceiling": 0.65}, False, ("reject", "cluttered_background")),
        ({"sharpness_score": 30.0}, {}, False, ("reject", "blurry_frame")),
        ({"sharpness_score": 60.0, "overall_score": 45.0}, {}, False, ("maybe", "threshold_maybe")),
        ({"sharpness_score": 59.0, "overall_score": 45.0}, {}, False, ("reject", "threshold_reject")),
        ({"personal_score": 71.0, "personal_std": 8.0}, {}, True, ("maybe", "uncertain")),
        ({"personal_score": 71.0, "personal_std": 7.9}, {}, True, ("keep", "personal_keep")),
        ({"personal_score": 45.0, "personal_std": 0.0}, {}, True, ("maybe", "personal_maybe")),
        ({"personal_score": 44.0, "personal_std": 0.0}, {}, True, ("reject", "personal_reject")),
        ({"personal_score": 90.0, "personal_std": 0.0}, {}, False, ("keep", "threshold_keep")),
    ],
)
def test_auto_decision(spark, row, t, ready, want):
    assert judge(spark, Thresholds(**t), ready, **row) == want


def rescue(spark, *rows):
    return {r.id: r.old_decision for r in decide.burst_rescue(spark.createDataFrame(list(rows), MEMBER)).collect()}


def test_burst_rescue(spark):
    closed = [member(i, face=1, fs=fs, decision="reject", reason="closed_eyes") for i, fs in ((1, 30.0), (2, 70.0), (3, 20.0))]
    assert rescue(spark, *closed) == {2: "reject"}
    assert rescue(spark, *closed, member(4, decision="keep")) == {}
    physical = [member(i, decision="reject", reason="blurry_frame") for i in (1, 2)]
    assert rescue(spark, *physical) == {}
    assert rescue(spark, *physical, member(3, sh=10.0, decision="reject", reason=None)) == {}
    assert rescue(spark, *physical, member(3, sh=10.0, decision="reject", reason="soft_face")) == {1: "reject"}
    assert rescue(spark, member(1, sh=90.0, decision="maybe", reason="threshold_maybe"), member(2, decision="reject", reason="threshold_reject")) == {}
    assert rescue(spark, member(1, sh=10.0, decision="maybe", reason="x"), member(2, decision="reject", reason="x")) == {2: "reject"}
    assert rescue(spark, member(1, decision="reject", reason="closed_eyes")) == {}


def reasons(spark, rows, hero, overridden=False):
    heroes = spark.createDataFrame([(1, hero, overridden)], "group_id long, hero long, overridden boolean")
    return groups.best_reason(spark.createDataFrame(rows, MEMBER), heroes).first().reason


def test_best_reason(spark):
    a = member(1, face=1, fs=60.9, eyes=1, sh=50.0)
    assert reasons(spark, [a, member(2, face=1, fs=20.9), member(3, face=1, fs=31.0)], 1) == "Sharpest face (60 vs avg 25)"
    assert reasons(spark, [a, member(2)], 1, True) == "Your pick"
    assert reasons(spark, [a], 1) == "Only photo in group"
    assert reasons(spark, [member(1, face=1, fs=0.0, eyes=1), member(2, eyes=0, sh=80.0)], 1) == "Eyes open — others blinked"
    assert reasons(spark, [member(1, sh=80.0), member(2, sh=70.0)], 1) == "Sharpest frame (80 vs avg 70)"
    assert reasons(spark, [member(1, iqa=9.0), member(2, iqa=8.0)], 1) == "Best perceptual quality (TOPIQ)"
    assert reasons(spark, [member(1, aes=9.0), member(2, aes=8.0)], 1) == "Best aesthetic score"
    assert reasons(spark, [member(1), member(2)], 1) == "Highest overall score"


def test_candidates_keep_their_order_in_small_groups(spark):
    rows = [member(1, sh=1.0), member(2, sh=9.0), member(3, sh=5.0)]
    ranked = lambda n: {r.id: r["rank"] for r in groups.top_n_candidates(spark.createDataFrame(rows, MEMBER), n).collect()}
    assert ranked(3) == {1: 1, 2: 2, 3: 3}
    assert ranked(2) == {2: 1, 3: 2}


def test_hero_overrides_count_for_members_only(spark):
    rows = spark.createDataFrame([member(1, overall=10.0), member(2, overall=90.0)], MEMBER)
    over = lambda hero: spark.createDataFrame([("hero:1,2", hero)], "key string, hero long")
    assert groups.group_hero(rows, over(1)).first()[1:3] == (1, True)
    assert groups.group_hero(rows, over(7)).first()[1:3] == (2, False)
    assert groups.group_hero(rows).first()[1:3] == (2, False)


def test_rankings_expand_to_near_duplicates(spark):
    members = spark.createDataFrame([(1, 10, 1, [1.0, 0.0]), (1, 11, 2, [1.0, 0.0]), (1, 12, 3, [0.0, 1.0]), (1, 13, 4, None)], "group_id long, id long, pos int, embedding array<float>")
    leaders = similarity.collapse_near_duplicates(members)
    assert {r.id: r.leader_id for r in leaders.collect()} == {10: 10, 11: 10, 12: 12, 13: 13}
    rankings = spark.createDataFrame([(1, [(1, 2, "soft"), (2, 1, "best"), (3, 3, "odd")])], "group_id long, rankings array<struct<image_index:int,rank:int,reason:string>>")
    got = {r.id: (r["rank"], r.reason) for r in groups.expand_rankings(rankings, leaders).collect()}
    assert got == {10: (2, "soft"), 11: (2, "near-duplicate of #2"), 12: (1, "best"), 13: (3, "odd")}
    cache = spark.createDataFrame([], "members_hash string, outcome string")
    assert groups.ranking_outcome(members, leaders, cache).first().outcome == "needs_ranking"
    one = leaders.where("id < 12")
    found = groups.ranking_outcome(members.where("id < 12"), one, cache).first()
    assert found.outcome == "near_duplicates"
    again = spark.createDataFrame([(found.members_hash, "near_duplicates")], "members_hash string, outcome string")
    assert groups.ranking_outcome(members.where("id < 12"), one, again).first().outcome == "near_duplicates_cached"


def test_large_groups_are_led_in_rounds(spark, monkeypatch):
    """Leaders equal a plain loop over the photos in order, where groups span several blocks, half are copies and some have no vector."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = []
    for group, size in ((1, 150), (2, 16), (3, 1), (4, 17)):
        for n in range(size):
            x = rng.normal(size=4) if n % 2 else np.array([1.0, 2.0, 0.0, group])
            rows.append((group, group * 1000 + int(rng.permutation(900)[0]) * 1000000 + n, n // 2, None if n % 29 == 7 else (x / np.linalg.norm(x)).tolist()))
    want = {}
    for group in (1, 2, 3, 4):
        heads = []
        for _, i, _, x in sorted((r for r in rows if r[0] == group), key=lambda r: (r[2], r[1])):
            near = [] if x is None else [h for h, y in heads if np.dot(np.float32(x).astype(float), np.float32(y).astype(float)) >= 0.9]
            want[group, i] = near[0] if near else i
            if x is not None and not near:
                heads.append((i, x))
    found = similarity.collapse_near_duplicates(spark.createDataFrame(rows, "group_id long, id long, pos int, embedding array<float>"), 0.9).collect()
    assert len(found) == len(rows)
    assert {(r.group_id, r.id): r.leader_id for r in found} == want


def test_manual_groups(spark):
    images = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "")], "id long, manual_group_id string")
    got = lambda df: {r.id: r.manual_group_id for r in df.collect()}
    new = got(groups.set_manual_group(images, "new_group", [2, 1]))
    assert new[1] == new[2] and new[1] and new[3] == "x"
    single = got(groups.set_manual_group(images, "singletons", [1, 2]))
    assert single[1] != single[2]
    assert got(groups.set_manual_group(images, "join_group", [1], 3))[1] == "x"
    joined = got(groups.set_manual_group(images, "join_group", [1], 4))
    assert joined[1] == joined[4] and joined[1]
    assert got(groups.set_manual_group(images, "clear", [3]))[3] is None
    with pytest.raises(ValueError):
        groups.set_manual_group(images, "join_group", [1])


def test_gate(spark):
    rows = [
        ([1.0, 0.0], "indoor", None, [1.0, 0.0], "water", None, True),
        ([1.0, 0.0], None, [1.0], [0.0, 1.0], None, [1.0], False),
        (None, "water", [1.0], [1.0, 0.0], "indoor", [1.0], False),
        (None, "street", [1.0, 0.0], None, "indoor", [0.0, 1.0], False),
        (None, "street", [1.0, 0.0], None, "indoor", None, True),
        (None, None, None, None, None, None, True),
    ]
    kind = "a_face array<double>, a_scene string, a_hist array<double>, b_face array<double>, b_scene string, b_hist array<double>, want boolean"
    assert spark.createDataFrame(rows, kind).where(similarity.union_gate("a_", "b_") != F.col("want")).count() == 0


def test_similarity_groups_across_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    x = np.repeat(base, 9, 0) + 0.1 * rng.standard_normal((108, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), "2024-01-01 00:00:00") for i, v in enumerate(x)] + [(200, None, None), (201, x[0].tolist(), None)]
    photos = spark.createDataFrame(rows, "id long, embedding array<float>, shot_at string").withColumn("shot_at", F.to_timestamp("shot_at"))
    for block in (4096, 16):
        monkeypatch.setattr(similarity, "BLOCK", block)
        got = {r.id: r.group_id for r in similarity.group_by_similarity(photos, 0.8).collect()}
        assert got == {i: i // 9 * 9 for i in range(108)}
    everyone = {r.id: r.group_id for r in similarity.group_by_similarity(photos, 0.8, None).collect()}
    assert everyone[201] == 0
    anchored = photos.withColumn("manual_group_id", F.when(F.col("id").isin(0, 50), "m").when(F.col("id") == 1, "lonely").when(F.col("id") == 2, ""))
    got = {r.id: r.group_id for r in similarity.group_by_similarity(anchored, 0.8).collect()}
    assert got[0] == got[50] == 0 and 1 not in got and got[2] == got[3] == 2


def test_bursts_at_the_gap_and_across_hours(spark):
    times = ["00:00:00", "00:00:02", "00:00:04.5", "00:59:59", "01:00:01", "01:00:02", "03:00:00", None]
    rows = [(i, None if t is None else f"2024-01-01 {t}", float(i), 0.0) for i, t in enumerate(times)]
    photos = spark.createDataFrame(rows, "id long, shot_at string, sharpness_score double, exposure_score double").withColumn("shot_at", F.to_timestamp("shot_at"))
    got = {r.id: (r.burst_id, r.role) for r in bursts.detect_bursts(photos).collect()}
    assert got == {0: (1, "burst_alternative"), 1: (1, "hero"), 2: (None, "single"), 3: (2, "burst_alternative"), 4: (2, "burst_alternative"), 5: (2, "hero"), 6: (None, "single"), 7: (None, "single")}
    summary = bursts.burst_summary(bursts.detect_bursts(photos)).first()
    assert (summary.total, summary["groups"], summary.burst_photos, summary.redundant, summary.reduction_pct) == (8, 2, 5, 3, 37.5)
    assert bursts.burst_summary(bursts.detect_bursts(photos.limit(0))).first().reduction_pct == 0.0


def test_scenes_axes_and_search(spark):
    photos = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.6, 0.8], 0), (3, None, 1)], "id long, embedding array<float>, face_detected int")
    tagged = {r.id: (r.scene, r.scene_confidence) for r in browse.tag_scene(photos, {"night": [0.0, 1.0], "street": [1.0, 0.0], "also": [1.0, 0.0]}).collect()}
    assert tagged == {1: ("street", 1.0), 2: ("night", 0.8), 3: (None, None)}
    axes = {r.id: (r.depth, r.eye_contact_score) for r in browse.concept_axes(photos, {"depth": ([1.0, 0.0], [0.0, 1.0]), "eye_contact_score": ([1.0, 0.0], [1.0, 0.0])}).collect()}
    assert axes[1] == (1.0, 0.5) and axes[2] == (0.018, None) and axes[3] == (None, None)
    assert [tuple(r) for r in browse.semantic_search(photos, [1.0, 0.0], 500, 0.2).collect()] == [(1, 1.0), (2, 0.6)]
    members = spark.createDataFrame([(1, 1), (1, 2)], "group_id long, id long")
    assert browse.search_groups(browse.semantic_search(photos, [1.0, 0.0]), members).first().best_id == 1


def test_forest_holds_the_same_components():
    rng = np.random.default_rng(5)
    for n, m in ((2, 1), (10, 3), (50, 49), (200, 2000), (1000, 700)):
        a, b = rng.integers(0, n, m) * 7, rng.integers(0, n, m) * 7
        keep = similarity.forest(a, b)

        def parts(x, y):
            parent = {int(v): int(v) for v in np.concatenate([a, b])}

            def root(v):
                while parent[v] != v:
                    v = parent[v]
                return v

            for u, v in zip(x.tolist(), y.tolist(), strict=True):
                u, v = root(u), root(v)
                parent[max(u, v)] = min(u, v)
            return {v: root(v) for v in parent}

        whole, thin = parts(a, b), parts(a[keep], b[keep])
        assert whole == thin and keep.sum() == len(whole) - len(set(whole.values()))


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("spread", "thresholds"), [(0.05, (0.9, -0.2)), (3.0, (0.3,))])
def test_tiles_lose_no_link(spark, spread, thresholds):
    """One segment of many tiles, some rows not of unit length, and small segments; all pairs by one product each."""
    rng = np.random.default_rng(8)
    x = np.repeat(_unit(rng.standard_normal((30, 12))), 20, 0) + spread * rng.standard_normal((600, 12)) / 12**0.5
    x = np.where(np.arange(600)[:, None] % 50 == 7, x * 1.01, _unit(x)).astype(np.float32)
    x[13] = 0
    segment = np.where(np.arange(600) < 540, 7, np.arange(600) // 10)
    frame = spark.createDataFrame([(i, x[i].tolist(), int(segment[i])) for i in range(600)] + [(900, None, 7)], "id long, embedding array<float>, segment long")
    y = x.astype(np.float64)
    scores = y @ y.T
    for threshold in thresholds:
        want = {(i, j) for i in range(600) for j in range(i + 1, 600) if segment[i] == segment[j] and scores[i, j] >= threshold}
        found = similarity.similarity_links(frame, threshold, 32).collect()
        assert len(found) == len(want) and {(r.a, r.b) for r in found} == want
        assert all(abs(r.cosine - scores[r.a, r.b]) < 1e-9 for r in found)
        whole = {r.id: r.group_id for r in similarity.connected(similarity.similarity_links(frame, threshold)).collect()}
        thin = {r.id: r.group_id for r in similarity.connected(similarity.component_links(frame, threshold, 32)).collect()}
        assert thin == whole


def test_embeddings_lose_no_link(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", F.lit(0).cast("long").alias("segment"))
    held = sorted(rows.collect())
    x = np.array([r.embedding for r in held], np.float64)
    for threshold in (0.25, 0.4):
        i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        want = {(held[a].id, held[b].id) for a, b in zip(i, j, strict=True)}
        assert {(r.a, r.b) for r in similarity.similarity_links(rows, threshold, 16).collect()} == want


def test_far_tiles_never_meet(spark):
    """Forty tight clusters: of all pairs of tiles only some form, and fewer rows are sent than if each tile went to every other."""
    rng = np.random.default_rng(9)
    x = _unit(np.repeat(_unit(rng.standard_normal((40, 16))), 50, 0) + 0.02 * rng.standard_normal((2000, 16)))
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, embedding array<float>, segment long")
    _, dealt, pairs = similarity.tiled(rows, 0.95, tile=25)
    tiles = dealt.select("cell", "tile").distinct().count()
    formed = pairs.count()
    assert tiles >= 80 and formed < tiles * (tiles + 1) / 2 / 4
    sizes = {(r.cell, r.tile): r["count"] for r in dealt.groupBy("cell", "tile").count().collect()}
    sent = sum(sizes.get((r.cell, r.tile), 0) + (sizes.get((r.other_cell, r.other_tile), 0) if (r.cell, r.tile) != (r.other_cell, r.other_tile) else 0) for r in pairs.collect())
    assert sent < 2000 * tiles / 4
    everything = similarity.tiled(rows, -1.0, tile=25)[2].count()
    assert everything >= tiles * (tiles + 1) / 2


def test_larger_segments_copy_rows_less(spark):
    """Tiles grow with the root of the segment, so the copies of a row do too, up to the largest tile."""
    for n, copies in ((1024, 1), (10_000, 7), (1_000_000, 63)):
        tile = spark.range(1).select(similarity._tile_rows(F.lit(n), None, similarity.MOST_TILE).alias("t")).first().t
        assert -(-n // tile) <= copies and tile <= similarity.MOST_TILE


def test_many_alike_photos_give_few_links(spark):
    """5000 photos of one segment, all alike: what grouping takes is fewer links than photos for each pair of blocks, and one group."""
    rows = spark.range(5000).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"), F.lit(0).cast("long").alias("segment"))
    links = similarity.component_links(rows, 0.9)
    tile = 16 * 5000**0.5
    pairs = sum(range(1, -(-5000 // int(tile)) + 1))
    assert links.count() < pairs * 2 * tile
    found = similarity.group_by_similarity(rows.withColumn("shot_at", F.lit("2024-01-01").cast("timestamp")), 0.9)
    assert found.agg(F.count("*"), F.count_distinct("group_id")).first() == (5000, 1)


def test_people_groups(spark):
    """Faces by their own threshold, over all times; photos without a face or not done stay out."""
    rows = [(1, 1, "done", [1.0, 0.0], "2020-01-01"), (2, 1, "done", [0.8, 0.6], "2024-01-01"), (3, 1, "done", [0.0, 1.0], None), (4, 0, "done", [1.0, 0.0], None), (5, 1, "pending", [1.0, 0.0], None), (6, 1, "done", None, None), (7, 1, "done", [-1.0, 0.0], None)]
    frame = spark.createDataFrame(rows, "id long, face_detected int, analysis_status string, face_embedding array<double>, t string").withColumn("shot_at", F.col("t").cast("timestamp"))
    assert {(r.group_id, r.id) for r in similarity.face_groups(frame).collect()} == {(1, 1), (1, 2), (1, 3)}


def test_runs_of_cameras_without_a_clock(spark):
    """Thousands of photos of one second are one run; gaps between hours count as within them."""
    times = ["1970-01-01 00:00:00"] * 3000 + ["2024-01-01 09:59:59", "2024-01-01 10:00:00", "2024-01-01 10:00:03", "2024-01-01 10:00:05", None]
    frame = spark.createDataFrame(list(enumerate(times)), "id long, t string").withColumn("shot_at", F.col("t").cast("timestamp"))
    got = {(r.run, r.n) for r in bursts.time_runs(frame, 2.0).groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, 3000), (2, 2), (3, 2)}


def test_quantiles_equal_sorting(spark):
    rng = np.random.default_rng(2)
    rows = [(k, None if rng.random() < 0.1 else float(rng.integers(0, 50)) / 4) for k in ("a", "b", None) for _ in range(rng.integers(3, 300))]
    frame = spark.createDataFrame(rows + [("c", None), ("d", 7.0)], "k string, v double")
    got = {r.k: (r.total, r.p5, r.half, r.p9) for r in ranks.quantiles(frame, "v", {"p5": 0.05, "half": 0.5, "p9": 0.9}, ("k",)).collect()}
    for key in ("a", "b", None):
        values = [v for k, v in rows if k == key and v is not None]
        assert got[key] == pytest.approx((len(values), *np.quantile(values, [0.05, 0.5, 0.9])))
    assert got["d"] == (1, 7.0, 7.0, 7.0) and "c" not in got


def test_pairs_go_on_until_enough_are_fresh(spark):
    """All first pairs were compared before, more than are asked for."""
    undecided = spark.range(400).select("id", (70 + F.col("id")).cast("double").alias("score"))
    done = spark.range(60).select((F.col("id") * 2).alias("winner_id"), (F.col("id") * 2 + 1).alias("loser_id"))
    got = groups.compare_pairs(undecided, done, 5).collect()
    assert [(r.pos, r.left_id, r.right_id) for r in got] == [(60 + k, 120 + 2 * k, 121 + 2 * k) for k in range(5)]
    assert groups.compare_pairs(undecided, done, 200).count() == 140


def test_no_window_without_partitions(spark):
    """The queue of pairs and that of training are numbered by ranges."""
    undecided = spark.range(400).select("id", (70 + F.col("id")).cast("double").alias("score"))
    done = spark.range(300).select((F.col("id") * 2).alias("winner_id"), (F.col("id") * 2 + 1).alias("loser_id"))
    images = spark.range(900).select("id", F.lit("done").alias("analysis_status"), (F.col("id") % 101).cast("double").alias("personal_score"), F.lit(50.0).alias("overall_score"))
    decided = spark.range(0, 900, 3).select(F.col("id").alias("image_id"), F.lit("keep").alias("decision"))
    for frame in (groups.compare_pairs(undecided, done, 100), groups.training_queue(images, decided)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        windows = re.findall(r"Window \[.*", plan)
        assert windows and not any(re.search(r"windowspecdefinition\([^,()#]+#\d+L? (ASC|DESC)", w) for w in windows)
        assert "SinglePartition" not in frame._jdf.queryExecution().executedPlan().toString()


def test_all_of_a_long_history_compared(spark):
    undecided = spark.range(1000).select("id", (70 + F.col("id")).cast("double").alias("score"))
    done = spark.range(500).select((F.col("id") * 2).alias("winner_id"), (F.col("id") * 2 + 1).alias("loser_id"))
    assert groups.compare_pairs(undecided, done, 5).count() == 0
    got = groups.compare_pairs(undecided, done.where("winner_id < 990"), 5).collect()
    assert [(r.pos, r.left_id) for r in got] == [(k, 2 * k) for k in range(495, 500)]


def test_queue_interleaves(spark):
    images = spark.range(2000).select("id", F.when(F.col("id") % 50 == 0, "pending").otherwise("done").alias("analysis_status"), F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 101).cast("double")).alias("personal_score"), F.when(F.col("id") % 11 > 0, 50.0).alias("overall_score"))
    decided = spark.range(0, 2000, 4).select(F.col("id").alias("image_id"), F.lit("keep").alias("decision"))
    rows = groups.training_queue(images, decided).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(len(rows)))
    new, again = [r.id for r in rows if not r.reshow], [r.id for r in rows if r.reshow]
    assert set(new) == {i for i in range(2000) if i % 50 and i % 4} and len(set(again)) == len(again) and all(i % 4 == 0 and i % 11 for i in again)
    distance = lambda i: min(abs(i * 37 % 101 - 70), abs(i * 37 % 101 - 45)) if i % 7 else math.inf
    assert new == sorted(new, key=lambda i: (distance(i), i))
    at = [k for k, r in enumerate(rows) if r.reshow]
    gaps = [b - a - 1 for a, b in zip([-1, *at], at, strict=False)]
    assert all(5 <= g <= 25 for g in gaps) and len(set(gaps)) > 10 and len(again) <= int(len(new) * 0.3)
    few = groups.training_queue(images, decided.where("image_id < 20")).where("reshow").count()
    assert few == 4
    unscored = groups.training_queue(images.withColumn("personal_score", F.lit(None).cast("double")), decided).where("not reshow").orderBy("place").collect()
    assert {r.id for r in unscored} == set(new) and [r.id for r in unscored] != sorted(new)
    assert groups.training_queue(images.limit(0), decided).count() == 0


def test_selection_by_counts_equals_sorting(spark):
    rng = np.random.default_rng(4)
    special = [0.0, -0.0, 1e300, -1e300, 1e-310, -5.5, float("nan"), None, float("inf")]
    rows = [(["keep", "reject", "maybe"][i % 3], *(special[rng.integers(0, 9)] if rng.random() < 0.1 else float(rng.normal(0, 10.0 ** rng.integers(-3, 5))) for _ in range(2)), 7.0) for i in range(900)]
    for kind, cast in (("double", float), ("float", lambda v: float(np.float32(v)))):
        frame = spark.createDataFrame(rows, "k string, a double, b double, same double").select("k", *(F.col(c).cast(kind).alias(c) for c in ("a", "b", "same")))
        places = lambda n: (0, n // 3, n // 2, n - 1)
        got = ranks.refined_places(frame, ("a", "b", "same"), places, "k", ("keep", "reject", "none"))
        for n, column in enumerate(("a", "b", "same"), 1):
            for group in ("keep", "reject"):
                values = sorted(cast(r[n]) for r in rows if r[0] == group and r[n] is not None and r[n] == r[n])
                assert got[column, group] == (len(values), [values[k] for k in places(len(values))])
            assert got[column, "none"] == (0, [])
        whole = ranks.refined_places(frame, ("a",), lambda n: (n // 2,))
        values = sorted(cast(r[1]) for r in rows if r[1] is not None and r[1] == r[1])
        assert whole["a", None] == (len(values), [values[len(values) // 2]])


def test_numbered(spark):
    rows = spark.range(5000).select("id", (F.col("id") * 7919 % 613).alias("x"))
    got = ranks.numbered(rows, [F.col("x").desc(), F.col("id")], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: (-r.x, r.id))] == list(range(5000))
    assert ranks.numbered(rows.limit(0), [F.col("x")], "n").count() == 0
