import math
import zlib

import pytest
from pyspark.sql import functions as F

from shutterloom.llm import compression_quality as cq


def test_windows():
    assert cq.windows(b"") == [b""]
    text = bytes(range(256)) * 9
    assert b"".join(cq.windows(text)) == text
    assert len(cq.spread_windows("x" * 100_000)) == cq.WINDOWS_OF_A_TEXT
    assert cq.spread_windows(None) == [b""]


def test_own_dictionary_compresses_better():
    good, bad = (cq.compressor(cq.build_dictionary([f"{w}{k} ".encode() * 9 for k in range(300)])) for w in ("river", "%%%#"))
    assert cq.measure_text(b"river7 river19 river3", good, bad)[0] > 0.1
    assert cq.measure_text(b"%%%#5 %%%#22 %%%#99", good, bad)[0] < -0.1


def test_tiny_dictionaries():
    for samples in ([], [b"a"], [b"abc"] * 3):
        c = cq.compressor(cq.build_dictionary(samples))
        assert c.compress(b"text")


@pytest.mark.parametrize("rows", [[], [(0.1, -1.0, 1)], [(0.1, -1.0, 0)] * 3, [(0.2, -1.0, 1), (-0.2, -1.0, 0)] * 20])
def test_curve(rows):
    base, lean, density = cq.fit_curve(rows)
    assert all(math.isfinite(x) for x in (base, lean, density))
    if len(rows) > 3:
        assert lean > 0 and base + lean * 0.2 - density > 1 > -1 > base - lean * 0.2 - density


def test_held_out_accuracy(spark):
    """On documents ten times as many as in the smallest table, as a dictionary needs texts."""
    sf_dir = "/root/testdata/sf0.1"
    rows = cq.op13_compression_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) > 0.99 * len(good)
    assert sum(1 - r.predicted for r in bad) > 0.85 * len(bad)
    pairs = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in good for b in bad)
    assert pairs > 0.99 * len(good) * len(bad)


def test_query(spark, sf_dir, texts):
    rows = cq.op13_compression_quality(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_labels_are_unread(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(cq.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r.doc_id: r.score for r in cq.score_quality(documents.select("doc_id", "text"), x).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, [1, 0, None, 7][i % 4]) for i in range(20)] + [(None, 1), (3, 0), (3, 1)], "doc_id bigint, quality int")
    docs = odd_docs.withColumns({c: F.lit("clash") for c in ("measured", "lean", "density", "score")})
    found = cq.score_quality(docs, labels)
    assert sorted(found.columns) == sorted(docs.columns)
    rows = found.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert cq.score_quality(no_docs, labels).count() == 0
    assert len({r.score for r in cq.score_quality(docs, labels.limit(0)).collect()}) == 1
