"""Automatic decisions and burst rescue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DECISIONS, Thresholds
from ..functions.scalars import all_faces_closed, parse_fraction
from ..functions.scores import zero
from ..sources.catalog import delete_images
from .groups import candidate_order
from .similarity import group_by_similarity

#: Reasons that lie in the frame itself, so that no photo of the group is better.
PHYSICAL = ("iso_ceiling", "reciprocal_rule", "blurry_frame")
#: Reject reasons that a preview counts by name; all other rejects are "low_score".
NAMED_REASONS = ("closed_eyes", "soft_face", "blurry_frame", "cluttered_background")


def auto_decision(columns: list[str], t: Thresholds = Thresholds(), ready: bool = False) -> Column:
    """Struct (decision, reason) of the first rule that holds, for rows with some of the catalog's columns.

    Scores that are null count as 0, a column that `columns` lacks, or a text that is no number, as null. The exposure
    time may be text like '1/250'. Personal rules need a model that is `ready`.
    """
    col = lambda name, kind="double": F.col(name).try_cast(kind) if name in columns else F.lit(None).cast(kind)
    sharp, face_sharp, overall = (zero(col(c)) for c in ("sharpness_score", "face_sharpness_score", "overall_score"))
    face = zero(col("face_detected", "int")) == 1
    rules: list[tuple[Column, str, str]] = []
    if t.reject_closed_eyes:
        closed = face & (col("eyes_open", "int") == 0)
        if t.closed_eyes_all_faces:
            closed &= all_faces_closed(col("faces_eyes_open_json", "string"), col("face_count", "int"))
        rules.append((closed, "reject", "closed_eyes"))
    if t.reject_soft_face:
        rules.append((face & (face_sharp < t.face_sharpness_floor) & (sharp >= t.sharpness_floor), "reject", "soft_face"))
    if t.iso_ceiling:
        rules.append((col("iso") > t.iso_ceiling, "reject", "iso_ceiling"))
    if t.reject_reciprocal_rule:
        focal = col("focal_length_mm")
        rules.append(((focal > 0) & (parse_fraction(col("shutter_speed", "string")) > 1 / F.nullif(focal, F.lit(0.0))), "reject", "reciprocal_rule"))
    if t.background_ceiling is not None:
        rules.append((face & (col("background_distraction_score") >= t.background_ceiling), "reject", "cluttered_background"))
    if ready:
        score, std = col("personal_score"), col("personal_std")
        if t.uncertain_to_maybe:
            near = (F.abs(score - t.keep) <= std) | (F.abs(score - t.maybe) <= std)
            rules.append(((std >= t.uncertainty) & near, "maybe", "uncertain"))
        rules += [(score >= t.keep, "keep", "personal_keep"), (score >= t.maybe, "maybe", "personal_maybe"), (score.isNotNull(), "reject", "personal_reject")]
    if t.reject_blurry_frame:
        rules.append((sharp < t.sharpness_floor, "reject", "blurry_frame"))
    rules += [
        (overall >= t.fallback_keep, "keep", "threshold_keep"),
        ((overall >= t.fallback_maybe) & (sharp >= t.fallback_maybe_sharpness), "maybe", "threshold_maybe"),
        (F.lit(True), "reject", "threshold_reject"),
    ]
    chain = None
    for holds, decision, reason in rules:
        verdict = F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))
        chain = F.when(holds, verdict) if chain is None else chain.when(holds, verdict)
    return chain


def undecided(images: DataFrame, decided: DataFrame, folder: str | None = None) -> DataFrame:
    """J3."""
    done = images.where("analysis_status = 'done'")
    done = done if folder is None else done.where(F.col("source_folder") == folder)
    return done.join(decided.select(F.col("image_id").alias("id")), "id", "left_anti")


def burst_rescue(members: DataFrame) -> DataFrame:
    """(group_id, id, old_decision, reason): the promotions to maybe.

    members: photos with group_id, pos, decision and reason. A group of two or more without a keep, not all
    rejected for what lies in the frame, has its best candidate promoted, unless that is a maybe already.
    """
    kinds = members.groupBy("group_id").agg(
        F.count("*").alias("size"),
        F.bool_or(F.col("decision") == "keep").alias("kept"),
        F.bool_and(F.coalesce(F.col("reason").isin(*PHYSICAL), F.lit(True))).alias("physical"),
        F.count("reason").alias("reasons"),
    )
    open_groups = kinds.where("size >= 2 and not kept and not (physical and reasons > 0)").select("group_id")
    # The best candidate as one maximum over a struct, so a large group is summed before it is shuffled.
    key = candidate_order()
    parts = [F.when(zero(F.col("face_detected")) == 1, zero(F.col("face_sharpness_score"))).otherwise(F.lit(0.0)), *(zero(F.col(c)).cast("double") for c in ("eyes_open", "sharpness_score", "iqa_score", "aesthetic_score", "overall_score")), -F.col("pos")]
    assert len(parts) == len(key)
    best = members.groupBy("group_id").agg(F.max(F.struct(*(p.alias(f"k{n}") for n, p in enumerate(parts)), "id", "decision", "reason")).alias("w"))
    return best.join(open_groups, "group_id", "left_semi").where("w.decision <> 'maybe'").select("group_id", "w.id", F.col("w.decision").alias("old_decision"), "w.reason")


def auto_cull(images: DataFrame, decided: DataFrame, threshold: float = 0.90, gap: float = 60.0, folder: str | None = None, t: Thresholds = Thresholds(), ready: bool = False) -> DataFrame:
    """D3: (id, decision, reason, promoted) of every undecided photo, after rescue; reason is that of the first decision.

    Groups are made without the gate. Photos need embedding and shot_at for groups; others stand alone.
    """
    open_rows = undecided(images, decided, folder)
    judged = open_rows.withColumn("verdict", auto_decision(open_rows.columns, t, ready)).withColumns({"decision": F.col("verdict.decision"), "reason": F.col("verdict.reason")}).drop("verdict")
    groups = group_by_similarity(open_rows.where("embedding is not null"), threshold, gap)
    members = groups.select("group_id", "id").join(judged, "id").withColumn("pos", F.col("id"))
    promoted = burst_rescue(members).select("id", F.lit(True).alias("promoted"))
    rows = judged.join(promoted, "id", "left")
    hit = F.coalesce("promoted", F.lit(False))
    return rows.select("id", F.when(hit, "maybe").otherwise(F.col("decision")).alias("decision"), "reason", hit.alias("promoted"))


def cull_summary(culled: DataFrame) -> DataFrame:
    """One row: decisions after rescue, still rejected photos by coarse rule, uncertain ones, promotions."""
    rejected = F.col("decision") == "reject"
    named = [F.count_if(rejected & (F.col("reason") == r)).alias(r) for r in NAMED_REASONS]
    return culled.agg(*(F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS), *named, F.count_if(rejected & ~F.col("reason").isin(*NAMED_REASONS)).alias("low_score"), F.count_if(F.col("reason") == "uncertain").alias("uncertain"), F.count_if("promoted").alias("promotions"))


def bulk_decision(ids: DataFrame, decision: str, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(image_id, decision) of the known ids, and the unknown ids."""
    if decision not in DECISIONS:
        raise ValueError(f"no such decision: {decision}")
    distinct = ids.select("id").distinct()
    known = images.select("id")
    return distinct.join(known, "id", "left_semi").select(F.col("id").alias("image_id"), F.lit(decision).alias("decision")), distinct.join(known, "id", "left_anti")


def trash_list(images: DataFrame, decided: DataFrame) -> DataFrame:
    """Rejected photos."""
    return images.join(decided.where("decision = 'reject'").select(F.col("image_id").alias("id")), "id", "left_semi")


def trash_rejects(tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The rejected photos, whose files the caller moves to the trash, and the tables (as of delete_images()) without them."""
    gone = trash_list(tables["images"], tables["decisions"])
    return gone, delete_images(tables, gone)
