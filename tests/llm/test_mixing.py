import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shutterloom.llm import mixing as m


def reshared(sizes):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / whole
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_query(spark, sf_dir, documents):
    source = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in documents.collect()}
    sizes = defaultdict(int)
    for s, n in source.values():
        sizes[s] += n
    want = reshared(sizes)
    rows = m.op5_mixing(spark, sf_dir).collect()
    taken = defaultdict(int)
    assert len(rows) == len(source)
    for r in rows:
        s, n = source[r.doc_id]
        assert r.size == n and r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * n
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(rows) == sorted(m.op5_mixing(spark, sf_dir).collect())


def test_targets(spark):
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, None: 10, "z": 0}, {"x": 7}, {"a": 0}, {f"s{i:02}": i * i for i in range(30)}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in m.targets(frame).collect()}
        assert got == pytest.approx(reshared(sizes), abs=1e-6)


def test_blocks_are_used_evenly(spark, documents):
    """Every pass is a permutation: no block twice in it, and full passes use all."""
    _, pieces, slots = m.mix_plan(documents, shards=8)
    rows = slots.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source, r["pass"]].append(r.block)
    assert all(len(x) == len(set(x)) for x in by.values())
    words = m.shard_counts(slots).groupBy().sum("words").first()[0]
    assert words == sum(r["take"] for r in rows)
    held = pieces.groupBy("source", "block").agg({"end": "max", "start": "min"}).collect()
    assert all(r["min(start)"] == 0 for r in held)


def test_words_by_shard_equal_a_walk_through_the_slots(spark, documents):
    """Every slot's shard is drawn anew here, and its block's words are counted one document at a time."""
    sized, pieces, slots = m.mix_plan(documents, shards=8)
    hashed = slots.select("source", "ordinal", "block", "take", F.pmod(F.xxhash64("source", "ordinal", F.lit(7 + 2)), F.lit(8)).alias("drawn")).collect()
    at, drawn, total = defaultdict(list), defaultdict(int), defaultdict(int)
    for r in pieces.collect():
        at[r.source, r.block].append(r)
    doc = {r.rid: r.id for r in sized.collect()}
    want = defaultdict(int)
    for s in hashed:
        drawn[s.drawn, s.source] += 1
        total[s.source] += 1
        for p in at[s.source, s.block]:
            if min(p.end, s.take) > p.start:
                want[doc[p.rid], s.drawn] += min(p.end, s.take) - p.start
    got = {(r.doc_id, x.shard): x.words for r in m.mix(documents, shards=8).collect() for x in r.shards}
    assert got == dict(want)
    counts = {(r.shard, r.source): r.slots for r in m.shard_counts(slots).collect()}
    assert counts == dict(drawn)
    # As multinomial draws go: each within six standard deviations of an even share.
    assert all(abs(counts.get((k, s), 0) - n / 8) <= 6 * (n * 7 / 64) ** 0.5 + 1 for s, n in total.items() for k in range(8))


def test_small_slices(spark, documents, monkeypatch):
    """More slices give another order of a stream, and the same totals."""
    whole = {s: n for s, n in m.mix(documents).groupBy("source").sum("taken").collect()}
    monkeypatch.setattr(m, "SLICE_ROWS", 1)
    again = m.mix(documents)
    assert {s: n for s, n in again.groupBy("source").sum("taken").collect()} == whole
    assert again.where("taken > 2 * size").count() == 0


def test_documents(spark, documents, odd_docs, no_docs):
    out = m.mix_documents(documents)
    assert out.columns == documents.columns
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = {r.doc_id: r.taken for r in m.mix(documents).collect()}
    got = defaultdict(int)
    whole = {r.doc_id: r.text for r in documents.collect()}
    for r in out.collect():
        got[r.doc_id] += count(r.text)
        assert r.n_chars == len(r.text)
        assert r.text == whole[r.doc_id] or set(r.text.split()) <= set(whole[r.doc_id].split())
    assert dict(got) == {i: n for i, n in want.items() if n}
    assert m.mix_documents(no_docs).count() == 0 and m.mix(no_docs).count() == 0
    assert m.mix(odd_docs).count() == odd_docs.count()
    assert m.mix_documents(odd_docs).columns == odd_docs.columns
    assert m.mix_documents(odd_docs).count() > 0
