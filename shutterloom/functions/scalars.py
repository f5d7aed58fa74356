"""String, date and JSON scalars (X1 to X14) and vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The columns of a file's tags, and the groups that a tag's name may carry.
EXIF_COLUMNS = ("camera", "shot_at", "focal_length_mm", "aperture", "shutter_speed", "iso", "lens_model", "film_simulation")
TAG_GROUPS = ("EXIF:", "MakerNotes:", "Composite:", "File:", "")


def parse_fraction(text: Column) -> Column:
    """X1: '1/250' or a plain number; null for a zero divisor or anything else."""
    parts = F.split(F.trim(text), "/")
    top, below = parts[0].try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 1, top).when(F.size(parts) == 2, F.try_divide(top, below))


def camera_name(model: Column) -> Column:
    """The short name of a known camera, else the stripped model."""
    plain = F.trim(model)
    return F.when(plain.contains("X100VI"), "X100VI").when(plain.contains("X-H") | plain.contains("X Half"), "X Half").when(plain.contains("Z 6") | plain.contains("Z6"), "Z6III").otherwise(plain)


def make_and_model(make: Column, model: Column) -> Column:
    """X2: 'Make Model' unless the model holds the make."""
    make, model = F.trim(make), F.trim(model)
    return F.when(F.coalesce(make, F.lit("")) == "", model).when(F.lower(model).contains(F.lower(make)), model).otherwise(F.concat_ws(" ", make, model))


def exif_timestamp(*tags: Column) -> Column:
    """The first tag that reads as 'YYYY:MM:DD HH:MM:SS'."""
    return F.coalesce(*(F.try_to_timestamp(F.substring(t, 1, 19), F.lit("yyyy:MM:dd HH:mm:ss")) for t in tags))


def _tag(tags: Column, *names: str) -> Column:
    """The first of the named tags that isn't missing or empty."""
    return F.coalesce(*(F.nullif(tags[n], F.lit("")) for n in names))


def _grouped(tags: Column, *names: str) -> Column:
    """As _tag(), of names under any of the groups, in order of name and then of group."""
    return _tag(tags, *(group + n for n in names for group in TAG_GROUPS))


def _stamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))


def _plain_tags(tags: Column) -> list[Column]:
    iso = F.trim(_tag(tags, "EXIF ISOSpeedRatings"))
    return [
        camera_name(_tag(tags, "Image Model")),
        _stamp(_tag(tags, "EXIF DateTimeOriginal", "Image DateTime")),
        *(parse_fraction(_tag(tags, n)) for n in ("EXIF FocalLength", "EXIF FNumber", "EXIF ExposureTime")),
        F.when(iso.rlike(r"^[+-]?\d+$"), iso.try_cast("int")),
        F.trim(_tag(tags, "EXIF LensModel", "MakerNote LensModel")),
        F.lit(None).cast("string"),
    ]


def _grouped_tags(tags: Column) -> list[Column]:
    model, number = _grouped(tags, "Model"), lambda *names: _grouped(tags, *names).try_cast("double")
    return [
        F.when(model.isNotNull(), make_and_model(_grouped(tags, "Make"), model)),
        _stamp(F.substring(_grouped(tags, "DateTimeOriginal", "CreateDate", "DateTime"), 1, 19)),
        number("FocalLength"),
        number("FNumber", "ApertureValue"),
        number("ExposureTime"),
        number("ISO", "ISOSpeedRatings").try_cast("int"),
        F.trim(_grouped(tags, "LensModel", "Lens", "LensInfo", "LensID")),
        F.trim(_grouped(tags, "FilmMode", "PictureControlBase")),
    ]


def normalize_exif(plain: Column, grouped: Column) -> Column:
    """Struct of EXIF_COLUMNS from two maps of tag names to texts, as two readers of one file give them.

    The second map stands for the whole first one if that has no camera, no time and no ISO, and if there is a second; single
    values are never mixed. Empty tags are missing ones. The first tag that is there decides: one that can't be read isn't
    made good by the next. In the second map names may carry a group of TAG_GROUPS, and numbers are plain.
    """
    named = lambda values: F.struct(*(v.alias(n) for n, v in zip(EXIF_COLUMNS, values, strict=True)))
    # Each step binds what it has made, so that a long expression for a map stands in the plan once.
    maps = F.array(F.struct(plain.alias("plain"), grouped.alias("grouped")))
    both = F.transform(maps, lambda x: F.struct(named(_plain_tags(x["plain"])).alias("a"), named(_grouped_tags(x["grouped"])).alias("b"), x["grouped"].isNotNull().alias("more")))
    bare = lambda x: x["more"] & x["a"]["camera"].isNull() & x["a"]["shot_at"].isNull() & x["a"]["iso"].isNull()
    return F.transform(both, lambda x: F.when(bare(x), x["b"]).otherwise(x["a"]))[0]


def file_name(path: Column) -> Column:
    """X5."""
    return F.substring_index(path, "/", -1)


def parent_folder(path: Column) -> Column:
    """X5."""
    return F.regexp_replace(path, "/[^/]*$", "")


def file_format(path: Column) -> Column:
    """Upper-case extension."""
    return F.upper(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def maker_from_filename(name: Column) -> Column:
    """X6."""
    return F.when(name.startswith("DSCF"), "Fujifilm").when(name.startswith("DSC_"), "Nikon").otherwise("Unknown")


def week_period(at: Column) -> Column:
    """Year and week of the year, weeks starting on Monday, days before the first Monday in week 00."""
    return F.format_string("%04d-W%02d", F.year(at), F.floor((F.dayofyear(at) + 6 - F.weekday(at)) / 7).cast("int"))


def month_period(at: Column) -> Column:
    """X7."""
    return F.date_format(at, "yyyy-MM")


def to_unix(text: Column) -> Column:
    """Seconds from a number, or from ISO text with or without Z; null for anything else."""
    iso = F.coalesce(*(F.try_to_timestamp(F.regexp_replace(text, "Z$", ""), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd")))
    return F.coalesce(text.try_cast("double"), F.unix_timestamp(iso).cast("double"))


def joined_ids(ids: Column) -> Column:
    return F.concat_ws(",", F.transform(F.sort_array(ids), lambda x: x.cast("string")))


def members_hash(ids: Column) -> Column:
    """Of the ids in order of number."""
    return F.sha1(joined_ids(ids))


def hero_key(ids: Column) -> Column:
    """X10."""
    return F.concat(F.lit("hero:"), joined_ids(ids))


def format_shutter(seconds: Column) -> Column:
    """X11."""
    return F.when(seconds >= 1, F.concat(F.round(seconds).cast("long"), F.lit("s"))).when(seconds > 0, F.concat(F.lit("1/"), F.round(1 / seconds).cast("long"), F.lit("s")))


def format_duration(seconds: Column) -> Column:
    """X11: hours, minutes and seconds, zero parts left out."""
    total = F.greatest(F.lit(0), F.round(seconds)).cast("long")
    hours, minutes, rest = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    part = lambda n, unit: F.when(n > 0, F.concat(n, F.lit(unit)))
    text = F.concat_ws(" ", part(hours, "h"), F.when((minutes > 0) | ((hours > 0) & (rest > 0)), F.concat(minutes, F.lit("m"))), part(rest, "s"))
    return F.when(seconds.isNotNull(), F.when(text == "", "0s").otherwise(text))


def all_faces_closed(faces_json: Column, face_count: Column) -> Column:
    """Every listed face has closed eyes (null counts as closed); without a list, there is one face at most."""
    faces = F.from_json(faces_json, "array<boolean>")
    return F.when(F.size(faces) > 0, F.forall(faces, lambda x: ~F.coalesce(x, F.lit(False)))).otherwise(F.coalesce(face_count, F.lit(0)) <= 1)


def parse_rankings(reply: Column, n: Column) -> Column:
    """Array of (image_index, rank, reason) from a reply that may wrap its JSON; null unless indexes and ranks run from 1 to n."""
    body = F.regexp_extract(F.regexp_replace(reply, "```[a-z]*", ""), r"(?s)(\[.*\])", 1)
    rows = F.from_json(body, "array<struct<image_index:int,rank:int,reason:string>>")
    full = F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))
    whole = (F.size(rows) == n) & (F.array_sort(rows["image_index"]) == full) & (F.array_sort(rows["rank"]) == full) & F.forall(rows["reason"], lambda x: x.isNotNull())
    return F.when(whole, rows)


def setting_float(text: Column, default: float, low: float, high: float) -> Column:
    """X14."""
    value = text.try_cast("double")
    return F.when((value >= low) & (value <= high), value).otherwise(F.lit(default))


def setting_bool(text: Column, default: bool) -> Column:
    """X14."""
    return F.when(text.isNull(), F.lit(default)).otherwise(F.lower(F.trim(text)).isin("1", "true", "yes", "on"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def encode_embedding(vector: Column) -> Column:
    """S17."""
    return F.to_json(vector)


def decode_embedding(text: Column) -> Column:
    """Null for malformed or empty text."""
    vector = F.from_json(text, "array<float>")
    return F.when((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull()), vector)


def progress(done: Column, total: Column, elapsed: Column) -> Column:
    """Struct of percent done and seconds left at the rate so far."""
    return F.struct(F.when(total > 0, F.round(100 * done / total, 1)).otherwise(F.lit(0.0)).alias("pct"), F.when(done > 0, elapsed / done * (total - done)).alias("eta"))
