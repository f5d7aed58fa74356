"""Quality by compression with two dictionaries.

Two zstandard dictionaries are built from windows of good and of bad labelled texts. A text is cut into
windows, each compressed on its own with either dictionary, so that a text can't explain itself but for what the
window holds. The difference of the two total sizes over their sum, and the log of that sum by the text's length, go
through a logistic curve fitted to labelled texts that no dictionary was built from.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stash, table, unused

#: Labelled rows that are learned from, at most: those whose ids hash lowest. Their ids are broadcast.
MOST_LABELLED = 20_000
#: Texts of each class that a dictionary is built from at most, and windows of each, spread over the whole text.
DICTIONARY_TEXTS, WINDOWS_OF_A_TEXT = 1500, 8
#: Bytes of a window and of a dictionary, and the compression level.
WINDOW, DICTIONARY, LEVEL = 512, 1 << 16, 3
#: One labelled row of so many is for the curve; the others are for the dictionaries.
CALIBRATION = 3
FOLDS = 5
MEASURES = "struct<lean:double,density:double>"
_ARROW = pa.struct([("lean", pa.float64()), ("density", pa.float64())])


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % FOLDS == 0


def windows(text: bytes) -> list[bytes]:
    """The text in pieces of WINDOW bytes; an empty one is one empty piece."""
    return [text[k : k + WINDOW] for k in range(0, len(text), WINDOW)] or [b""]


def spread_windows(text: str | None) -> list[bytes]:
    """At most WINDOWS_OF_A_TEXT windows of a text, from its beginning to its end."""
    found = windows((text or "").encode("utf-8", "surrogatepass"))
    n = min(len(found), WINDOWS_OF_A_TEXT)
    return [found[k * len(found) // n] for k in range(n)]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None
    if held:
        held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def measure_text(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float]:
    """How much shorter the good dictionary makes the text than the bad one, from -1 to 1, and the log of both sizes by length."""
    pieces = windows(text)
    a, b = (sum(len(c.compress(p)) for p in pieces) for c in (good, bad))
    return (b - a) / (a + b), float(np.log((a + b) / max(1, len(text))))


_built: dict = {}


def measures(text: Column, good: bytes, bad: bytes) -> Column:
    """MEASURES of a text; the dictionaries are of bounded size and travel with the function."""
    key = hashlib.sha256(good + b"/" + bad).digest()

    def measure(texts: pa.Array) -> pa.Array:
        if key not in _built:
            _built.clear()
            _built[key] = (compressor(good), compressor(bad))
        found = np.array([measure_text(t or b"", *_built[key]) for t in texts.cast(pa.binary()).to_pylist()], float).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], fields=list(_ARROW))

    return F.arrow_udf(measure, MEASURES)(text)


def fit_curve(rows: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """Intercept and slopes of the logistic curve over (lean, density, label), by Newton steps with a small penalty on standardised measures."""
    y = np.array([r[2] for r in rows], float)
    base = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if y.sum() in (0, len(y)):
        return float(base), 0.0, 0.0
    x = np.array([r[:2] for r in rows])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    design = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    theta = np.array([base, 0.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (y - p) - 1e-2 * theta
        bend = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(3)
        step = np.clip(np.linalg.solve(bend, slope), -2, 2)
        theta = theta + step
        if np.abs(step).max() < 1e-9:
            break
    slopes = theta[1:] / scale
    return float(theta[0] - slopes @ mean), float(slopes[0]), float(slopes[1])


def learn(labelled: DataFrame) -> tuple[bytes, bytes, tuple[float, float, float]]:
    """The good and the bad dictionary and the curve, from rows (key, text, label).

    The driver gets DICTIONARY_TEXTS times WINDOWS_OF_A_TEXT windows of each class, and two numbers for each row of the curve.
    """
    for_curve = F.pmod("key", F.lit(CALIBRATION)) == 0

    def cut(text: pa.Array) -> pa.Array:
        return pa.array([spread_windows(t) for t in text.to_pylist()], pa.list_(pa.binary()))

    dictionaries = {}
    for label in (1, 0):
        # Cut before they are chosen, so that long texts weigh no more than their windows where the chosen ones meet.
        pieces = labelled.where(~for_curve & (F.col("label") == label)).select("key", F.xxhash64("text").alias("mark"), F.arrow_udf(cut, "array<binary>")("text").alias("w"))
        rows = pieces.orderBy("key", "mark").limit(DICTIONARY_TEXTS).collect()
        dictionaries[label] = build_dictionary([bytes(w) for row in rows for w in row.w])
    found = labelled.where(for_curve).select(measures(F.col("text"), dictionaries[1], dictionaries[0]).alias("m"), "label").select("m.lean", "m.density", "label")
    return dictionaries[1], dictionaries[0], fit_curve([tuple(r) for r in found.collect()])


def score_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", to: str = "score") -> DataFrame:
    """docs with `to`: how likely label 1 is, from 0 to 1, from the text alone; an existing column `to` is replaced.

    labels (doc_id, quality): rows of ids whose checksum falls into the held-out fold are not learned from, nor are null
    labels; contradictory ones count each. Of the others MOST_LABELLED are learned from, a sample by hash. Null texts count as empty, and both have
    a score; repeated rows have each theirs. Without labels of both classes every text has the same score. An empty table gives no rows.
    """
    marked = labels.where("quality in (0, 1)").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"), F.xxhash64("doc_id", F.lit(17)).alias("key"))
    sample = marked.orderBy("key", "id", "label").limit(MOST_LABELLED)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id").select("key", "text", "label")
    good, bad, (base, lean, density) = learn(stash(rows, "compression-quality"))
    (name,) = unused(docs, "measured")
    m = F.col(name)
    scored = docs.withColumn(name, measures(F.col(text), good, bad))
    return scored.withColumn(to, 1 / (1 + F.exp(-(F.lit(base) + lean * m["lean"] + density * m["density"])))).drop(name)


def op13_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
