import hashlib

import pytest
from pyspark.sql import functions as F

from shutterloom.functions import scalars as x
from shutterloom.functions import scores as s


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(v, kind=None):
    return F.lit(v).cast(kind) if kind else F.lit(v)


def cases():
    return [
        (s.exposure_score(lit(128.0), lit(0.0), lit(0.0)), 100),
        (s.exposure_score(lit(255.0), lit(100.0), lit(0.0)), 15),
        (s.exposure_score(lit(0.0), lit(0.0), lit(100.0)), 22),
        (s.exposure_score(lit(98.0), lit(2.0), lit(0.0)), 90),
        (s.sharpness_score(lit(2.3)), 50.0),
        (s.sharpness_score(lit(99.0)), 100.0),
        (s.aesthetic_score(lit(10.0)), 100.0),
        (s.aesthetic_score(lit(0.5)), 50.0),
        (s.iqa_score(lit(1.7)), 100.0),
        (s.iqa_score(lit(None, "double")), None),
        (s.aesthetic_score(lit(None, "double")), None),
        (s.sharpness_score(lit(None, "double")), None),
        (s.exposure_score(lit(None, "double"), lit(0.0), lit(0.0)), None),
        (s.shake_score(lit(0.8), lit(3.5)), 20),
        (s.shake_score(lit(0.1), lit(1.0)), 100),
        (s.exif_risk(lit(None, "double"), lit(50.0), lit(100), lit("X Half")), "unknown"),
        (s.exif_risk(lit(0.02), lit(50.0), lit(100), lit("X Half")), "low"),
        (s.exif_risk(lit(0.02), lit(50.0), lit(12800), lit("X Half")), "moderate"),
        (s.exif_risk(lit(0.04), lit(50.0), lit(100), lit("X Half")), "moderate"),
        (s.exif_risk(lit(0.3), lit(50.0), lit(100), lit("X100VI")), "low"),
        (s.exif_risk(lit(0.5), lit(None, "double"), lit(100), lit(None, "string")), "low"),
        (s.exif_risk(lit(0.01), lit(None, "double"), lit(100), lit(None, "string")), "moderate"),
        (s.shake_warning(lit(0.1), lit(3.5)), "severe_shake"),
        (s.shake_warning(lit(0.6), lit(1.0)), "shake"),
        (s.shake_warning(lit(0.1), lit(1.6)), "slight_shake"),
        (s.shake_warning(lit(0.3), lit(1.5)), "ok"),
        (s.iqa_label(lit(55.0)), "Good"),
        (s.aesthetic_label(lit(35.9)), "Poor"),
        (s.aesthetic_label(lit(None, "double")), None),
        (s.reweighted(lit(9.0), lit(None, "double"), lit(2.0), 0.5), 9.0),
        (s.reweighted(lit(9.0), lit(0.1), lit(0.2), 0.5), 0.2),
        (s.face_quality(lit(1), lit(50.0), lit(0), lit(0.5)), 25.0),
        (s.face_quality(lit(0), lit(50.0), lit(0), lit(0.5)), None),
        (s.headline_score(lit(1.0), lit(2.0), False), 1.0),
        (s.headline_score(lit(1.0), lit(None, "double"), True), 1.0),
        (s.decision_folder(lit("keep"), lit("/a"), lit("")), "/a/_Keeps"),
        (s.decision_folder(lit("keep"), lit("/a"), lit("/b")), "/b"),
        (x.parse_fraction(lit("1/250")), 0.004),
        (x.parse_fraction(lit("1/0")), None),
        (x.parse_fraction(lit("0.5")), 0.5),
        (x.parse_fraction(lit("a/b")), None),
        (x.camera_name(lit(" NIKON Z 6_3 ")), "Z6III"),
        (x.make_and_model(lit("NIKON"), lit("Nikon Z")), "Nikon Z"),
        (x.make_and_model(lit("FUJIFILM"), lit("X-T5")), "FUJIFILM X-T5"),
        (x.file_format(lit("/a.b/c.raf")), "RAF"),
        (x.parent_folder(lit("/a.b/c.raf")), "/a.b"),
        (x.week_period(lit("2024-01-01").cast("timestamp")), "2024-W01"),
        (x.week_period(lit("2023-01-01").cast("timestamp")), "2023-W00"),
        (x.week_period(lit("2024-12-31").cast("timestamp")), "2024-W53"),
        (x.to_unix(lit("2024-01-01T00:00:00Z")), 1704067200.0),
        (x.to_unix(lit("12.5")), 12.5),
        (x.to_unix(lit("junk")), None),
        (x.members_hash(F.array(lit(10), lit(9))), hashlib.sha1(b"9,10").hexdigest()),
        (x.hero_key(F.array(lit(10), lit(9))), "hero:9,10"),
        (x.format_shutter(lit(0.004)), "1/250s"),
        (x.format_duration(lit(3600)), "1h"),
        (x.format_duration(lit(3605)), "1h 0m 5s"),
        (x.format_duration(lit(125)), "2m 5s"),
        (x.format_duration(lit(0)), "0s"),
        (x.all_faces_closed(lit("[false, null]"), lit(2)), True),
        (x.all_faces_closed(lit("[false, true]"), lit(2)), False),
        (x.all_faces_closed(lit(None, "string"), lit(1)), True),
        (x.all_faces_closed(lit("junk"), lit(2)), False),
        (x.setting_float(lit("7"), 1.0, 0, 5), 1.0),
        (x.setting_bool(lit(" YES "), False), True),
        (x.cosine(F.array(lit(0.0), lit(0.0)), F.array(lit(1.0), lit(0.0))), 0.0),
        (x.decode_embedding(lit("[1.0, 2")), None),
        (x.decode_embedding(lit("[1, 2.5]")), [1.0, 2.5]),
    ]


def test_scalars(spark):
    pairs = cases()
    row = spark.range(1).select(*(c.alias(f"c{n}") for n, (c, _) in enumerate(pairs))).first()
    for n, (column, want) in enumerate(pairs):
        assert row[n] == (pytest.approx(want) if isinstance(want, float) else want), column


def test_rankings(spark):
    good = 'Here: ```json\n[{"image_index": 2, "rank": 1, "reason": "a"}, {"image_index": 1, "rank": 2, "reason": "b"}]\n```'
    for reply, ok in ((good, True), (good.replace('"rank": 2', '"rank": 1'), False), ("none", False), (good.replace(', "reason": "b"', ""), False)):
        got = value(spark, x.parse_rankings(F.lit(reply), F.lit(2)))
        assert bool(got) == ok
    assert value(spark, x.parse_rankings(F.lit(good), F.lit(3))) is None


def test_fact_sheet(spark):
    row = spark.sql("SELECT 'X' camera, 23.0D focal_length_mm, 2.0D aperture, 0.004D shutter_speed, 200 iso, 71.0D overall_score, 39.0D sharpness_score, CAST(NULL AS DOUBLE) exposure_score, CAST(NULL AS DOUBLE) iqa_score, 45.0D aesthetic_score, 1 face_detected, 2 face_count, 0 eyes_open, 12.4D face_sharpness_score")
    text = row.select(s.fact_sheet().alias("v")).first().v
    assert text.startswith("Camera: X\nSettings: 23mm · f/2.0 · 1/250s · ISO 200\n\nTechnical scores (0–100):\n  Overall: 71.0 (good)\n") and text.endswith("\n\nWrite your 2–3 sentence narrative explanation now:")
    assert "Overall: 71.0 (good)" in text and "Sharpness: 39.0 (poor)" in text and "Exposure: N/A (N/A)" in text and "Perceptual" not in text and "\n\nFaces:\n  2 face(s) detected, eyes CLOSED, face sharpness 12\n" in text
