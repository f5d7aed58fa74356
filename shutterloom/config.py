"""Thresholds and fixed values of the catalog jobs."""

from __future__ import annotations

from dataclasses import dataclass

DECISIONS = ("keep", "maybe", "reject")
PHOTO_EXTENSIONS = ("jpg", "jpeg", "raf", "nef", "png", "tiff", "tif")
DECISION_FOLDERS = {"keep": "_Keeps", "maybe": "_Maybes", "reject": "_Trash"}
SCENES = ("portrait", "landscape", "street", "night", "macro", "indoor", "action", "water")
SCHEMA_VERSION = 6


@dataclass(frozen=True)
class Thresholds:
    """Cutoffs and switches of the automatic decision; the fields' values are the defaults."""

    keep: float = 70.0
    maybe: float = 45.0
    fallback_keep: float = 60.0
    fallback_maybe: float = 40.0
    fallback_maybe_sharpness: float = 60.0
    sharpness_floor: float = 40.0
    face_sharpness_floor: float = 20.0
    reject_soft_face: bool = True
    reject_blurry_frame: bool = True
    reject_closed_eyes: bool = True
    closed_eyes_all_faces: bool = False
    reject_reciprocal_rule: bool = False
    iso_ceiling: float | None = None
    background_ceiling: float | None = None
    uncertain_to_maybe: bool = True
    uncertainty: float = 8.0


#: Scene pairs that are never one scene, each in alphabetical order.
BLOCKED_SCENES = (
    ("indoor", "landscape"),
    ("indoor", "night"),
    ("indoor", "water"),
    ("action", "indoor"),
    ("landscape", "portrait"),
    ("landscape", "macro"),
    ("macro", "portrait"),
    ("night", "portrait"),
    ("portrait", "water"),
    ("action", "macro"),
    ("macro", "night"),
    ("macro", "water"),
)

#: The features of the personal model, in order; scene_is_* follow SCENES.
FEATURES = (
    "sharpness_score",
    "exposure_score",
    "iqa_score",
    "aesthetic_score",
    "highlight_clip_pct",
    "shadow_clip_pct",
    "shake_detected",
    "face_present",
    "face_detected",
    "face_count",
    "face_sharpness_score",
    "eyes_open",
    "eye_openness_ratio",
    "face_size_ratio",
    "smile_score",
    "mouth_open_score",
    "focal_length_mm",
    "aperture",
    "iso",
    *(f"scene_is_{s}" for s in SCENES),
    "subject_prominence_score",
    "background_distraction_score",
    "eye_contact_score",
    "decisive_moment_score",
)

#: The section under which a dashboard lists a feature; any other is "other".
FEATURE_SECTIONS = {
    "technical": ("sharpness_score", "exposure_score", "iqa_score", "highlight_clip_pct", "shadow_clip_pct", "shake_detected"),
    "face": ("face_present", "face_detected", "face_count", "face_sharpness_score", "face_size_ratio", "eye_openness_ratio", "eyes_open", "smile_score", "mouth_open_score"),
    "camera": ("focal_length_mm", "aperture", "iso"),
    "scene": tuple(f"scene_is_{s}" for s in SCENES),
    "aesthetic": ("aesthetic_score", "subject_prominence_score", "background_distraction_score", "eye_contact_score", "decisive_moment_score"),
}

#: Fixed values: (below, label) of the dashboard's classes; the last has no bound.
FOCAL_CLASSES = ((21, "<21mm"), (28, "21–27mm"), (35, "28–34mm"), (50, "35–49mm"), (70, "50–69mm"), (105, "70–104mm"), (200, "105–199mm"), (None, "200mm+"))
APERTURE_CLASSES = ((1.6, "f/1.4"), (2.2, "f/2"), (3.2, "f/2.8"), (4.5, "f/4"), (6.4, "f/5.6"), (9, "f/8"), (13, "f/11"), (None, "f/16+"))
ISO_CLASSES = ((200, "100"), (400, "200"), (800, "400"), (1600, "800"), (3200, "1600"), (6400, "3200"), (12800, "6400"), (None, "12800+"))

#: Sortable columns of the catalog.
SORT_FIELDS = (
    "shot_at",
    "filename",
    "sharpness_score",
    "exposure_score",
    "overall_score",
    "highlight_clip_pct",
    "shadow_clip_pct",
    "iqa_score",
    "aesthetic_score",
    "face_sharpness_score",
    "eye_openness_ratio",
    "smile_score",
    "mouth_open_score",
    "face_size_ratio",
    "personal_score",
    "iso",
    "aperture",
    "focal_length_mm",
)
