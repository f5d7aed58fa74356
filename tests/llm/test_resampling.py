import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shutterloom.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest):
    words = WORD.findall((text or "").translate(CAPITALS))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def bucket(run, buckets):
    return zlib.crc32(run.encode("utf-8", "surrogatepass")) % buckets


def brute(docs, target, longest, buckets, per_cent, least_words, seed):
    """Rows (id, n_words, n_features, weight, score) and the places of the drawn ones, by the definition."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(bucket(r, buckets) for r in runs(text, longest)[1])
    for text in target:
        t.update(bucket(r, buckets) for r in runs(text, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for id, text in docs:
        words, features = runs(text, longest)
        weight = sum(gain(bucket(r, buckets)) for r in features)
        h = int(hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
        out.append((id, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, fit[: len(fit) * per_cent // 100]


def compare(found, docs, target, longest, buckets, per_cent, least_words, seed):
    rows, drawn = brute(docs, target, longest, buckets, per_cent, least_words, seed)
    got = found.collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(rows, key=repr)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [tuple(r)[:5] for r in ranked] == drawn


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_buckets_are_checksums_of_the_runs(longest):
    chosen = random.Random(5)
    texts = ["", "one", "A-b  C", "ä ß日本 日本", "x" * 70_000 + " y", "\x00\x7f[{`@/:", "Same same SAME", *("".join(chosen.choices("abcZ9 ,\n{é日🙂", k=300)) for _ in range(40))]
    found = resampling.text_buckets([t.encode() for t in texts], longest, 10_007)
    for text, (n, got) in zip(texts, found, strict=True):
        words, features = runs(text, longest)
        assert n == len(words) and got.tolist() == [bucket(r, 10_007) for r in features]


def test_joined_crc():
    parts = [(b"", b""), (b"a", b""), (b"", b"bc"), (b"hello", b" world"), (b"x", b"y" * 100_000)]
    got = resampling.joined_crc(*(np.array(x) for x in zip(*((np.uint32(zlib.crc32(a)), np.uint32(zlib.crc32(b)), len(b)) for a, b in parts), strict=True)))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


@pytest.mark.parametrize("options", [(1, 10_000, 10, 20, 2024), (3, 50, 37, 1, 7)])
def test_equals_brute_force(spark, sf_dir, texts, options):
    names = ("longest", "buckets", "per_cent", "least_words", "seed")
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = resampling.importance(docs, target, **dict(zip(names, options, strict=True)))
    compare(found, sorted(texts.items()), [r.text for r in target.select("text").collect()], *options)


def test_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([("word words",), (None,), ("日本語",)], "text string")
    options = {"buckets": 100, "per_cent": 50, "least_words": 1}
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    compare(resampling.importance(odd_docs, target, **options), rows, ["word words", None, "日本語"], 1, 100, 50, 1, 2024)
    assert resampling.importance(no_docs, target).count() == 0
    assert resampling.importance(odd_docs, no_docs).count() == odd_docs.count()


def test_resample_keeps_columns(spark, odd_docs):
    docs = odd_docs.withColumn("drawn", odd_docs["doc_id"]).withColumn("rank", odd_docs["doc_id"])
    target = spark.createDataFrame([("word",)], "text string")
    found = resampling.importance(docs, target, least_words=1, per_cent=60).where("rank is not null")
    ids = {r.doc_id for r in found.collect()} - {None}
    kept = resampling.resample(docs, target, least_words=1, per_cent=60)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == ids


def test_draw_nears_the_target(spark):
    docs = spark.createDataFrame([(i, ("law court judge " if i % 5 == 0 else "ball goal team ") * 10) for i in range(500)], "doc_id bigint, text string")
    target = spark.createDataFrame([("court judge law " * 50,)], "text string")
    drawn = resampling.importance(docs, target, per_cent=20).where("rank is not null").collect()
    assert len(drawn) == 100 and all(r.doc_id % 5 == 0 for r in drawn)
