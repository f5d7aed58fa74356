"""Scalar scores and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DECISION_FOLDERS

#: Fixed values: (deviation of the mean from 128, penalty) and (clipped %, share of the largest penalty).
BRIGHTNESS_POINTS = ((0, 0), (30, 5), (50, 18), (80, 35), (128, 50))
CLIPPING_POINTS = ((0, 0.0), (1, 0.05), (2, 0.15), (5, 0.45), (10, 0.75), (20, 1.0))
HIGHLIGHT_PENALTY, SHADOW_PENALTY = 35.0, 28.0
SHARPNESS_THRESHOLD = 2.3
#: Stops of in-body stabilisation by camera; others have none.
STABILISATION = {"X100VI": 4, "X Half": 0, "Z6III": 5}


def zero(x: Column) -> Column:
    """Null counts as 0."""
    return F.coalesce(x, F.lit(0))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within the bounds; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def overall_score(sharpness: Column, exposure: Column, weight: float = 0.65) -> Column:
    """C1."""
    return F.bround(sharpness * weight + exposure * (1 - weight), 1)


def reweighted(old: Column, sharpness: Column, exposure: Column, weight: float) -> Column:
    """The new weight where both parts are known, halves rounded away from zero."""
    both = sharpness.isNotNull() & exposure.isNotNull()
    return F.when(both, F.round(sharpness * weight + exposure * (1 - weight), 1)).otherwise(old)


def sharpness_score(normalized: Column, threshold: float = SHARPNESS_THRESHOLD) -> Column:
    """50 at the threshold, 100 at most; one threshold holds for all formats."""
    return clamp(F.bround(normalized / threshold * 50, 0), 0.0, 100.0)


def sharpness_label(score: Column) -> Column:
    return F.when(score >= 70, "Sharp").when(score >= 40, "Borderline").when(score.isNotNull(), "Blurry")


def piecewise_linear(x: Column, points: tuple[tuple[float, float], ...]) -> Column:
    """Linear between the points, constant outside them; null stays null."""
    value = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        value = value.when(x <= x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0))
    return value.when(x.isNotNull(), F.lit(float(points[-1][1])))


def exposure_score(mean: Column, highlights: Column, shadows: Column) -> Column:
    """C4: 100 less penalties for brightness and for clipping at either end, as a whole number."""
    clipped = HIGHLIGHT_PENALTY * piecewise_linear(highlights, CLIPPING_POINTS) + SHADOW_PENALTY * piecewise_linear(shadows, CLIPPING_POINTS)
    score = F.bround(100 - piecewise_linear(F.abs(mean - 128), BRIGHTNESS_POINTS) - clipped, 0)
    return clamp(score, 0.0, 100.0).cast("int")


def exposure_warning(mean: Column, highlights: Column, shadows: Column) -> Column:
    """C5."""
    return F.when(highlights > 2, "clipped_highlights").when(shadows > 5, "clipped_shadows").when(mean < 50, "dark").when(mean > 200, "bright").otherwise("ok")


def exposure_intentional(mean: Column, std: Column) -> Column:
    """Low key or high key."""
    return ((mean < 80) & (std > 40)) | ((mean > 200) & (std > 35))


def exif_risk(shutter: Column, focal: Column, iso: Column, camera: Column) -> Column:
    """Risk of hand shake from exposure time, focal length, ISO and the camera's stabilisation.

    Without a focal length, times below 1/60 s are moderate and longer ones low, as the catalogs at hand have it.
    """
    stops = F.lit(0)
    for name, n in STABILISATION.items():
        stops = F.when(camera == name, n).otherwise(stops)
    safe = F.pow(F.lit(2.0), stops) / focal
    risk = (
        F.when(shutter.isNull(), "unknown")
        .when(focal.isNull() | (focal <= 0), F.when(shutter < 1 / 60, "moderate").otherwise("low"))
        .when(shutter <= safe, "low")
        .when(shutter <= 2 * safe, "moderate")
        .otherwise("high")
    )
    return F.when((risk == "low") & (iso > 6400), "moderate").otherwise(risk)


def _steps(x: Column, *steps: tuple[float, int]) -> Column:
    """The first (limit, loss) that x exceeds."""
    out = F.lit(0)
    for limit, loss in reversed(steps):
        out = F.when(x > limit, loss).otherwise(out)
    return out


def shake_score(consistency: Column, elongation: Column) -> Column:
    """100 less steps for edges that run one way and for a stretched spectrum."""
    return F.greatest(F.lit(0), 100 - _steps(consistency, (0.7, 50), (0.5, 35), (0.3, 15)) - _steps(elongation, (3.0, 30), (2.0, 20), (1.5, 10)))


def shake_warning(consistency: Column, elongation: Column) -> Column:
    """How severe, by the worse of both."""
    beyond = lambda c, e: (consistency > c) | (elongation > e)
    return F.when(beyond(0.7, 3.0), "severe_shake").when(beyond(0.5, 2.0), "shake").when(beyond(0.3, 1.5), "slight_shake").otherwise("ok")


def shake_intentional(angle: Column, consistency: Column) -> Column:
    """A pan."""
    return ((angle < 20) | (angle > 160)) & (consistency > 0.3) & (consistency < 0.65)


def pixel_risk(warning: Column) -> Column:
    """The risk that a shake_warning() stands for."""
    return F.when(warning.isin("shake", "severe_shake"), "high").when(warning == "slight_shake", "moderate").otherwise("low")


def shake_conflict(exif: Column, warning: Column) -> Column:
    """Whether exif_risk() and the pixels' shake_warning() disagree; never for an unknown risk."""
    return (exif != pixel_risk(warning)) & (exif != "unknown")


def iqa_score(raw: Column) -> Column:
    """C10."""
    return F.bround(clamp(raw, 0.0, 1.0) * 100, 1)


def aesthetic_score(raw: Column) -> Column:
    """C11: raw values above 1.5 are on a scale of 1 to 10."""
    on_ten = (clamp(raw, 1.0, 10.0) - 1) / 9 * 100
    on_one = clamp(raw, 0.0, 1.0) * 100
    return F.bround(F.when(raw > 1.5, on_ten).otherwise(on_one), 1)


def quality_label(score: Column, excellent: float, good: float, fair: float) -> Column:
    """The word for a score by its lower limits; null stays null."""
    return F.when(score >= excellent, "Excellent").when(score >= good, "Good").when(score >= fair, "Fair").when(score.isNotNull(), "Poor")


def iqa_label(score: Column) -> Column:
    """C10."""
    return quality_label(score, 75, 55, 35)


def aesthetic_label(score: Column) -> Column:
    """C11."""
    return quality_label(score, 46, 42, 36)


def burst_score(sharpness: Column, exposure: Column, shake: Column | None = None) -> Column:
    """Unknown shake counts as none."""
    still = F.lit(100.0) if shake is None else F.coalesce(shake, F.lit(100.0))
    return 0.5 * zero(sharpness) + 0.3 * zero(exposure) + 0.2 * still


def face_quality(detected: Column, sharpness: Column, eyes_open: Column, size: Column) -> Column:
    """Null without a face."""
    raw = zero(sharpness) - F.when(eyes_open == 0, 35).otherwise(0) + F.least(F.lit(10.0), 50 * zero(size))
    return F.when(zero(detected) == 1, clamp(raw, 0.0, 100.0))


def headline_score(overall: Column, personal: Column, ready: Column | bool) -> Column:
    """C14."""
    return F.when(F.lit(ready) if isinstance(ready, bool) else ready, F.coalesce(personal, overall)).otherwise(overall)


def uncertainty(score: Column, keep: float = 70.0, maybe: float = 45.0) -> Column:
    """C17: distance to the nearer boundary."""
    return F.least(F.abs(score - keep), F.abs(score - maybe))


def score_band(score: Column, low: float = 40, high: float = 70) -> Column:
    """C18."""
    return F.when(score.isNull(), "N/A").when(score >= high, "good").when(score >= low, "borderline").otherwise("poor")


def fact_sheet() -> Column:
    """The known scores and settings of a photo as text for a narrator; a sharpness, exposure, IQA or aesthetic score of 0 counts as unknown."""
    number = lambda x, digits: F.when(x.isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f", F.bround(x.cast("double"), digits)))
    known = lambda name: F.nullif(F.col(name).cast("double"), F.lit(0.0))
    scored = lambda label, x, low=40, high=70: F.concat(F.lit(f"  {label}: "), number(x, 1), F.lit(" ("), score_band(x, low, high), F.lit(")"))
    speed = F.col("shutter_speed")
    shutter = F.when(zero(speed) == 0, "N/A").when(speed >= 1, F.concat(number(speed, 0), F.lit("s"))).otherwise(F.concat(F.lit("1/"), F.bround(1 / speed).cast("long"), F.lit("s")))
    eyes = F.when(F.col("eyes_open").isNull(), "").when(F.col("eyes_open") == 0, ", eyes CLOSED").otherwise(", eyes open")
    sharp = F.when(F.col("face_sharpness_score").isNull(), "").otherwise(F.concat(F.lit(", face sharpness "), number(F.col("face_sharpness_score"), 0)))
    faces = F.concat(F.lit("\nFaces:\n  "), zero(F.col("face_count")), F.lit(" face(s) detected"), eyes, sharp)
    settings = [number(F.col("focal_length_mm"), 0), F.lit("mm · f/"), number(F.col("aperture"), 1), F.lit(" · "), shutter, F.lit(" · ISO "), F.coalesce(F.nullif(F.col("iso").cast("long"), F.lit(0)).cast("string"), F.lit("N/A"))]
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Camera: "), F.coalesce(F.nullif("camera", F.lit("")), F.lit("unknown camera"))),
        F.concat(F.lit("Settings: "), *settings),
        # The headings.
        F.lit("\nTechnical scores (0–100):"),
        scored("Overall", F.col("overall_score").cast("double")),
        scored("Sharpness", known("sharpness_score")),
        scored("Exposure", known("exposure_score")),
        F.when(known("iqa_score").isNotNull(), scored("Perceptual quality (TOPIQ)", known("iqa_score"), 35, 55)),
        F.when(known("aesthetic_score").isNotNull(), scored("Aesthetic appeal (LAION)", known("aesthetic_score"), 30, 50)),
        F.when(zero(F.col("face_detected")) == 1, faces).otherwise("\nFaces: none detected"),
        F.lit("\nWrite your 2–3 sentence narrative explanation now:"),
    )


def decision_folder(decision: Column, source_folder: Column, override: Column) -> Column:
    """C20: the override where it isn't empty, else the decision's folder below the source."""
    name = F.lit(None).cast("string")
    for d, folder in DECISION_FOLDERS.items():
        name = F.when(decision == d, folder).otherwise(name)
    return F.when(override != "", override).otherwise(F.concat(source_folder, F.lit("/"), name))
