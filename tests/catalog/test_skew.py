"""Groups that are too large for one task."""

import hashlib

import pytest
from pyspark.sql import functions as F

from shutterloom.operators import bursts, groups, skew
from shutterloom.storage import written

SIZES = {1: 2, 2: 40, 3: 5000, 4: 1}


@pytest.fixture
def members(spark, monkeypatch):
    monkeypatch.setattr(skew, "LARGE", 100)
    ids = {g: [10_000 * g + 3 * k for k in range(n)] for g, n in SIZES.items()}
    pairs = spark.createDataFrame([(g, i) for g, held in ids.items() for i in held], "group_id long, id long")
    score = F.pmod(F.xxhash64("id"), F.lit(700)).cast("double")
    images = pairs.select("id").withColumns({c: score for c in ("overall_score", "sharpness_score", "iqa_score", "aesthetic_score", "face_sharpness_score")} | {c: F.lit(1) for c in ("face_detected", "eyes_open")})
    return ids, written(groups.member_rows(pairs, images)), groups.member_rows(pairs, images)


def test_members_of_a_large_group_are_in_many_tasks(members):
    ids, rows, lazy = members
    assert {(r.group_id, r.id): r.pos for r in rows.collect()} == {(g, i): n for g, held in ids.items() for n, i in enumerate(held, 1)}
    held = [r["count"] for r in lazy.where("group_id = 3").groupBy(F.spark_partition_id()).count().collect()]
    assert max(held) < SIZES[3] / 2
    heroes = groups.group_hero(rows)
    met = skew.beside(rows, written(heroes))
    assert met.count() == sum(SIZES.values()) and met.where("group_id = 3").rdd.getNumPartitions() >= rows.rdd.getNumPartitions()


def test_large_groups_have_the_results_of_small_ones(members, monkeypatch):
    ids, rows, _ = members

    def found():
        heroes = groups.group_hero(rows)
        keys, reasons, picks, top = groups.group_keys(rows), groups.best_reason(rows, heroes), groups.burst_pick_batch(rows, heroes), groups.top_n_candidates(rows, 2)
        return [sorted(map(tuple, df.collect())) for df in (keys.select("group_id", "members_hash", "size"), reasons, picks, top.select("group_id", "id", "rank"))]

    large = found()
    assert large[0] == [(g, hashlib.sha1(",".join(map(str, held)).encode()).hexdigest(), len(held)) for g, held in ids.items()]
    monkeypatch.setattr(skew, "LARGE", 1_000_000)
    assert found() == large


def test_one_burst_of_many_photos(spark, monkeypatch):
    rows = spark.range(3000).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") + F.when(F.col("id") >= 2900, 1000).otherwise(0)).alias("shot_at"), F.lit(50.0).alias("sharpness_score"), F.lit(50.0).alias("exposure_score"))
    usual = sorted(map(tuple, bursts.detect_bursts(rows, 2.0).collect()))
    monkeypatch.setattr(skew, "LARGE", 500)
    assert sorted(map(tuple, bursts.detect_bursts(rows, 2.0).collect())) == usual
    assert {r[1] for r in usual} == {1, 2}
