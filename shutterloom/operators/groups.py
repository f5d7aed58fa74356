"""Ranking and bookkeeping of groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hero_key, joined_ids, members_hash
from ..functions.scores import uncertainty, zero
from ..storage import written
from .ranks import numbered
from .skew import beside, parted, placed

#: New photos between two that come again, at least and at most.
LEAST_GAP, MOST_GAP = 5, 25
#: Gaps that one task adds up.
RESHOW_BLOCK = 1 << 16
#: Ids of a large group that are joined to one text.
HASH_BLOCK = 1024


def member_rows(groups: DataFrame, images: DataFrame) -> DataFrame:
    """Groups (group_id, id) with the photos' current columns and `pos`, the place by id in the group."""
    known = written(groups.select("group_id", "id").join(images.select("id"), "id", "left_semi"))
    rest = [c for c in images.columns if c != "id"]
    return placed(known).join(images, "id").select("id", "group_id", *rest, "pos")


def group_hero(members: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(group_id, hero, overridden, size): an override that is a member, else the best score, the first of equals.

    overrides (key, hero), the key as hero_key() makes it of a group's ids.
    """
    best = F.max_by("id", F.struct(zero(F.col("overall_score")).alias("s"), (-F.col("pos")).alias("p")))
    heroes = members.groupBy("group_id").agg(best.alias("best"), F.collect_list("id").alias("ids"), F.count("*").alias("size"))
    if overrides is None:
        return heroes.select("group_id", F.col("best").alias("hero"), F.lit(False).alias("overridden"), "size")
    picked = heroes.withColumn("key", hero_key(F.col("ids"))).join(overrides.select("key", F.col("hero").alias("picked")), "key", "left")
    valid = F.coalesce(F.array_contains("ids", F.col("picked")), F.lit(False))
    return picked.select("group_id", F.when(valid, F.col("picked")).otherwise(F.col("best")).alias("hero"), valid.alias("overridden"), "size")


def best_reason(members: DataFrame, heroes: DataFrame) -> DataFrame:
    """(group_id, hero, reason): the first thing in which the hero beats all other members."""
    if "size" not in heroes.columns:
        heroes = heroes.join(members.groupBy("group_id").agg(F.count("*").alias("size")), "group_id")
    rows = beside(members, written(heroes.select("group_id", "hero", "overridden", "size")))
    is_hero = F.col("id") == F.col("hero")
    of_hero = lambda c: F.max(F.when(is_hero, F.col(c)))
    face = zero(F.col("face_detected")) == 1
    others = lambda value, where=None: F.when(~is_hero if where is None else ~is_hero & where, value)
    sums = rows.groupBy("group_id", "hero", "overridden").agg(
        F.count_if(~is_hero).alias("n"),
        of_hero("face_detected").alias("face"),
        zero(of_hero("face_sharpness_score")).alias("fs"),
        of_hero("eyes_open").alias("eyes"),
        zero(of_hero("sharpness_score")).alias("sh"),
        of_hero("iqa_score").alias("iqa"),
        of_hero("aesthetic_score").alias("aes"),
        F.max(others(zero(F.col("face_sharpness_score")), face)).alias("o_fs"),
        F.avg(others(zero(F.col("face_sharpness_score")), face)).alias("o_fs_avg"),
        F.bool_or(others(F.coalesce(F.col("eyes_open") == 0, F.lit(False)))).alias("o_blink"),
        F.max(others(zero(F.col("sharpness_score")))).alias("o_sh"),
        F.avg(others(zero(F.col("sharpness_score")))).alias("o_sh_avg"),
        F.max(others(F.col("iqa_score"))).alias("o_iqa"),
        F.max(others(F.col("aesthetic_score"))).alias("o_aes"),
    )
    told = lambda what, own, avg: F.format_string(f"{what} (%d vs avg %d)", F.col(own).cast("long"), zero(F.col(avg).cast("long")))
    has_face = zero(F.col("face")) == 1
    reason = (
        F.when(F.col("overridden"), "Your pick")
        .when(F.col("n") == 0, "Only photo in group")
        .when(has_face & (F.col("fs") > 0) & (F.col("o_fs").isNull() | (F.col("fs") > F.col("o_fs"))), told("Sharpest face", "fs", "o_fs_avg"))
        .when(has_face & (F.col("eyes") == 1) & F.col("o_blink"), "Eyes open — others blinked")
        .when((F.col("sh") > 0) & (F.col("sh") > F.col("o_sh")), told("Sharpest frame", "sh", "o_sh_avg"))
        .when(F.col("iqa") > F.col("o_iqa"), "Best perceptual quality (TOPIQ)")
        .when(F.col("aes") > F.col("o_aes"), "Best aesthetic score")
        .otherwise("Highest overall score")
    )
    return sums.select("group_id", "hero", reason.alias("reason"))


def candidate_order() -> list[Column]:
    """Best first; null counts as 0; equals by place."""
    face_sharp = F.when(zero(F.col("face_detected")) == 1, zero(F.col("face_sharpness_score"))).otherwise(F.lit(0.0))
    return [face_sharp.desc(), *(zero(F.col(c)).desc() for c in ("eyes_open", "sharpness_score", "iqa_score", "aesthetic_score", "overall_score")), F.col("pos").asc()]


def top_n_candidates(members: DataFrame, n: int) -> DataFrame:
    """Members with `rank`: the n best of larger groups in order of candidate_order(); groups of n or fewer stay in order of place."""
    # One more than asked for tells larger groups; tasks leave out the others before they meet.
    by_key = F.row_number().over(Window.partitionBy("group_id").orderBy(*candidate_order()))
    best = members.withColumn("__key", by_key).where(F.col("__key") <= n + 1)
    sized = best.withColumn("__size", F.count("*").over(Window.partitionBy("group_id")))
    ranked = sized.withColumn("rank", F.when(F.col("__size") <= n, F.col("pos")).otherwise(F.col("__key")))
    return ranked.where(F.col("rank") <= n).drop("__size", "__key")


def prefilter_burst(members: DataFrame, most: int = 8) -> DataFrame:
    """G9."""
    return top_n_candidates(members, most)


def group_keys(members: DataFrame) -> DataFrame:
    """(group_id, members_hash, size). The ids of a large group pass one task as texts of HASH_BLOCK, some bytes an id, as a digest has an order."""
    rows = written(members.select("group_id", "id"))
    small, large = parted(rows)
    keys = small.groupBy("group_id").agg(F.collect_list("id").alias("ids"), F.count("*").alias("size")).select("group_id", members_hash(F.col("ids")).alias("members_hash"), "size")
    if large is None:
        return keys
    blocks = large.groupBy("group_id", F.floor((F.col("pos") - 1) / HASH_BLOCK).alias("block")).agg(joined_ids(F.collect_list("id")).alias("text"), F.count("*").alias("n"))
    dealt = blocks.repartition("group_id").sortWithinPartitions("group_id", "block")
    schema = f"group_id {rows.schema['group_id'].dataType.simpleString()}, members_hash string, size bigint"
    return keys.unionByName(dealt.mapInArrow(_hashed, schema))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group_id, block, text, n) in order as one row (group_id, members_hash, size) a group."""
    group, digest, size, kind = None, None, 0, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([group], kind), pa.array([digest.hexdigest()]), pa.array([size], pa.int64())], ["group_id", "members_hash", "size"])
    for batch in batches:
        kind = batch.column("group_id").type
        for key, text, n in zip(*(batch.column(c).to_pylist() for c in ("group_id", "text", "n")), strict=True):
            if digest is not None and key == group:
                digest.update(b",")
            else:
                if digest is not None:
                    yield row()
                group, digest, size = key, hashlib.sha1(), 0
            digest.update(text.encode())
            size += n
    if digest is not None:
        yield row()


def ranking_outcome(members: DataFrame, leaders: DataFrame, cache: DataFrame) -> DataFrame:
    """(group_id, outcome, members_hash): what a group's ranking needs.

    members: after the prefilter; leaders (group_id, id, leader_id): of their near-duplicates; cache
    (members_hash, outcome).
    """
    full = group_keys(members).select("group_id", "size", F.col("members_hash").alias("full_hash"))
    reps = group_keys(leaders.where("id = leader_id").select("group_id", "id")).select("group_id", F.col("size").alias("reps"), F.col("members_hash").alias("rep_hash"))
    kept = lambda name: cache.select(F.col("members_hash").alias(f"{name}_hash"), F.col("outcome").alias(f"{name}_outcome"))
    rows = full.join(reps, "group_id", "left").join(kept("full"), "full_hash", "left").join(kept("rep"), "rep_hash", "left")
    outcome = (
        F.when(F.col("size") < 2, "too_few")
        .when(F.col("full_outcome") == "near_duplicates", "near_duplicates_cached")
        .when(F.coalesce("reps", "size") < 2, "near_duplicates")
        .when(F.col("rep_outcome") == "ranked", "ranked_cached")
        .otherwise("needs_ranking")
    )
    stored = F.when(outcome.isin("near_duplicates_cached", "near_duplicates", "too_few"), F.col("full_hash")).otherwise(F.coalesce("rep_hash", "full_hash"))
    return rows.select("group_id", outcome.alias("outcome"), stored.alias("members_hash"))


def expand_rankings(rankings: DataFrame, leaders: DataFrame) -> DataFrame:
    """(group_id, id, rank, reason) of all members.

    rankings (group_id, rankings: array of image_index from 1, rank, reason) over a group's leaders in order
    of id; a near-duplicate has its leader's rank and says so.
    """
    ids = leaders.where("id = leader_id").groupBy("group_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    each = rankings.select("group_id", F.explode("rankings").alias("r")).join(ids, "group_id")
    ranked = each.select("group_id", F.element_at("ids", F.col("r.image_index")).alias("leader_id"), F.col("r.rank").alias("rank"), F.col("r.reason").alias("reason"))
    rows = leaders.select("group_id", "id", "leader_id").join(ranked, ["group_id", "leader_id"])
    own = F.col("id") == F.col("leader_id")
    return rows.select("group_id", "id", "rank", F.when(own, F.col("reason")).otherwise(F.format_string("near-duplicate of #%d", F.col("rank").cast("int"))).alias("reason"))


def prerank_state(members: DataFrame, cache: DataFrame, current: str | None = None) -> DataFrame:
    """(group_id, size, state) by the hash of the full membership; `current` is the one being ranked."""
    rows = group_keys(members).join(cache.select("members_hash", "outcome"), "members_hash", "left")
    state = F.when(F.col("size") < 3, "not_applicable").when(F.col("outcome") == "near_duplicates", "near_duplicates").when(F.col("outcome") == "ranked", "ready").when(F.col("members_hash") == F.lit(current), "in_progress").otherwise("pending")
    return rows.select("group_id", "size", state.alias("state"))


def prerank_queue(members: DataFrame, most: int = 20, least: int = 3) -> DataFrame:
    """The largest groups, by size and then by id."""
    return members.groupBy("group_id").agg(F.count("*").alias("size")).where(F.col("size") >= least).orderBy(F.desc("size"), "group_id").limit(most)


def anchors(images: DataFrame, patch: DataFrame) -> DataFrame:
    """images with manual_group_id changed as patch (id, manual_group_id) says; a null there clears."""
    changes = patch.select("id", F.col("manual_group_id").alias("__new"), F.lit(True).alias("__hit"))
    met = images.join(changes, "id", "left")
    return met.withColumn("manual_group_id", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("manual_group_id"))).select(*images.columns)


def set_manual_group(images: DataFrame, mode: str, ids: list[int], target: int | None = None) -> DataFrame:
    """Images after "new_group", "singletons", "join_group" (with target) or "clear" on the listed ids.

    A new anchor is named by the hash of its members' ids, so a rerun names it alike.
    """
    spark = images.sparkSession
    chosen = sorted(set(ids))
    rows = spark.createDataFrame([(i,) for i in chosen], "id bigint")
    if mode == "clear":
        return anchors(images, rows.withColumn("manual_group_id", F.lit(None).cast("string")))
    if mode == "singletons":
        return anchors(images, rows.withColumn("manual_group_id", members_hash(F.array("id"))))
    if mode == "new_group":
        return anchors(images, rows.withColumn("manual_group_id", members_hash(F.array(*map(F.lit, chosen)))))
    if mode != "join_group" or target is None:
        raise ValueError(f"no such mode, or no target: {mode}")
    found = images.where(F.col("id") == target).select("manual_group_id").first()
    if found is None:
        raise ValueError(f"no photo {target}")
    anchor = found[0] or None
    everyone = spark.createDataFrame([(i,) for i in {*chosen, target}], "id bigint")
    name = F.lit(anchor) if anchor else members_hash(F.array(*map(F.lit, sorted({*chosen, target}))))
    return anchors(images, everyone.withColumn("manual_group_id", name))


def grid_items(photos: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each group and each photo in none, at the place of the first member.

    photos (id, place): places ascend along the grid.
    """
    rows = photos.select("id", "place").join(groups.select("id", "group_id"), "id", "left")
    return rows.groupBy("group_id", F.when(F.col("group_id").isNull(), F.col("id")).alias("single")).agg(F.min("place").alias("place"), F.min_by("id", "place").alias("first_id"), F.count("*").alias("size")).drop("single")


def compare_pairs(undecided: DataFrame, done: DataFrame, n: int = 50) -> DataFrame:
    """(pos, left_id, right_id): the least certain photos in consecutive pairs, without pairs compared before.

    undecided (id, score), null and 0 scores counting as 50. The top 4 n rows are tried first; if too many of their pairs were compared
    before, all rows are numbered, by ranges, so that a history of any length is met in two steps.
    """
    score = F.when(zero(F.col("score")) == 0, 50.0).otherwise(F.col("score"))
    seen = written(done.select(F.least("winner_id", "loser_id").alias("x"), F.greatest("winner_id", "loser_id").alias("y")).distinct())
    rows = undecided.select("id", uncertainty(score).alias("u"))
    top = written(rows.orderBy("u", "id").limit(4 * n))
    fresh = _fresh_pairs(top, seen)
    if top.count() == 4 * n and fresh.limit(n).count() < n:
        fresh = _fresh_pairs(rows, seen)
    return fresh.orderBy("pos").limit(n).select("pos", "left_id", "right_id")


def _fresh_pairs(rows: DataFrame, seen: DataFrame) -> DataFrame:
    placed = numbered(rows, [F.col("u"), F.col("id")], "at")
    pairs = placed.groupBy(F.floor(F.col("at") / 2).alias("pos")).agg(F.min_by("id", "at").alias("left_id"), F.max_by("id", "at").alias("right_id"), F.count("*").alias("k")).where("k = 2")
    return pairs.join(seen, (F.least("left_id", "right_id") == F.col("x")) & (F.greatest("left_id", "right_id") == F.col("y")), "left_anti")


def _drawn(*parts: Column | str | int) -> Column:
    """A number below 2**32 from a digest of the parts."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _reshow_places(spark: SparkSession, most: int, seed: int) -> DataFrame:
    """(k, at): after how many new photos the k-th of `most` re-shows comes; the gaps between them are 5 to 25, drawn by k.

    Sums of whole blocks are made first, so that no task adds up all gaps.
    """
    gaps = spark.range(most).select(F.col("id").alias("k"), F.floor(F.col("id") / RESHOW_BLOCK).alias("block"), (LEAST_GAP + _drawn(seed, "gap", F.col("id")) % (MOST_GAP - LEAST_GAP + 1)).alias("gap"))
    sums, before, total = gaps.groupBy("block").agg(F.sum("gap")).collect(), [], 0
    for _, n in sorted(sums):
        before.append(total)
        total += n
    ahead = F.element_at(F.array(*map(F.lit, before or [0])).cast("array<bigint>"), F.col("block").cast("int") + 1)
    return gaps.select("k", (ahead + F.sum("gap").over(Window.partitionBy("block").orderBy("k"))).alias("at"))


def training_queue(images: DataFrame, decided: DataFrame, reshow: float = 0.3, seed: int = 42) -> DataFrame:
    """(place, id, reshow): the whole queue of photos to decide on, from place 0.

    New are analysed photos without a decision, the least certain by personal score first, those without one last; if none has one, all
    in a drawn order. Between them decided photos with an overall score come again, in a drawn order: one after each gap of 5 to 25 new ones,
    at most `reshow` times the number of new ones. Draws follow from the seed and the ids. Every order is made by ranges, not in one task.
    """
    rows = images.select("id", "analysis_status", "personal_score", "overall_score").join(decided.select(F.col("image_id").alias("id"), "decision"), "id", "left")
    fresh = written(rows.where("analysis_status = 'done' and decision is null").select("id", uncertainty(F.col("personal_score")).alias("u")))
    count, scored = fresh.agg(F.count("*"), F.count("u")).first()
    order = [F.col("u").asc_nulls_last(), F.col("id")] if scored else [_drawn(seed, "new", F.col("id")), F.col("id")]
    new = numbered(fresh, order, "place").select("id", (F.col("place") + 1).alias("at"), F.lit(False).alias("reshow"))
    again = rows.where("decision is not null and overall_score is not null").select("id")
    again = numbered(again, [_drawn(seed, "again", F.col("id")), F.col("id")], "k")
    places = _reshow_places(images.sparkSession, min(int(count * reshow), count // LEAST_GAP), seed)
    shown = again.join(places.where(F.col("at") <= count), "k").select("id", "at", F.lit(True).alias("reshow"))
    return numbered(new.unionByName(shown), [F.col("at"), F.col("reshow")], "place").select("place", "id", "reshow")


def burst_pick_batch(members: DataFrame, heroes: DataFrame, rest: str = "reject") -> DataFrame:
    """(id, decision): the hero is kept, the others are `rest`."""
    rows = beside(members.select("group_id", "id"), written(heroes.select("group_id", "hero", "size")))
    return rows.select("id", F.when(F.col("id") == F.col("hero"), "keep").otherwise(rest).alias("decision"))
