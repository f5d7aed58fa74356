import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from shutterloom.llm import sharding as s


def check(rows, texts, shards):
    slots = defaultdict(list)
    size = defaultdict(int)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert r.size == len(body) + 1 and r.text_crc32 == zlib.crc32(body)
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert set(slots) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return size


def test_query(spark, sf_dir, texts):
    rows = s.op3_sharding(spark, sf_dir).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    size = check(rows, texts, 16)
    mean = sum(size.values()) / 16
    largest = max(len((t or "").encode()) for t in texts.values()) + 1
    assert all(abs(x - mean) <= largest + 0.002 * mean for x in size.values())
    assert sorted(rows) == sorted(s.op3_sharding(spark, sf_dir).collect())


def test_hot_text_is_cut(spark):
    """A third of all rows are copies; sizes stay equal, and other equal texts together."""
    rows = [(i, "hot text") for i in range(3000)] + [(3000 + i, f"text {i // 2:05d}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = s.shard_by_bytes(docs, 16).collect()
    size = check(got, dict(rows), 16)
    mean = sum(size.values()) / 16
    assert all(abs(x - mean) < 0.01 * mean + 30 for x in size.values())
    of = defaultdict(set)
    for r in got:
        of[dict(rows)[r.doc_id]].add(r.shard)
    assert len(of.pop("hot text")) >= 5 and sum(len(x) > 1 for x in of.values()) <= 15


def test_cuts_against_a_sort(spark):
    keyed = spark.range(5000).select(F.xxhash64("id").alias("k1"), F.xxhash64("id", F.lit(1)).alias("k2"), (F.col("id") % 50 + 1).alias("size"))
    cuts, rounds = s.find_cuts(keyed, 10, 0.0)
    order = sorted(((r.k1 % (1 << 64), r.k2 % (1 << 64)), r["size"]) for r in keyed.collect())
    total, below, want = sum(x for _, x in order), 0, []
    starts = []
    for key, size in order:
        starts.append((below, key))
        below += size
    for j in range(1, 10):
        want.append(min(abs(b - j * total / 10) for b, _ in starts))
    for j, digits in enumerate(cuts, 1):
        first = int.from_bytes(bytes((*digits, *[0] * (16 - len(digits)))), "big")
        got = sum(x for (a, b), x in order if (a << 64 | b) < first)
        assert abs(got - j * total / 10) <= want[j - 1] + 50
    assert rounds <= 16


def test_odd_rows(odd_docs, no_docs):
    assert s.shard_by_bytes(odd_docs, 4).count() == odd_docs.count()
    assert s.shard_by_bytes(no_docs, 4).count() == 0
