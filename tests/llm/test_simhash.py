import math
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from shutterloom.llm import simhash as s


def fingerprint(text, k=3):
    """Word by word and bit by bit."""
    words = [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\v", b" ").replace(b"\f", b" ").replace(b"\r", b" ").split(b" ") if w]
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius):
    """Smallest id reachable, by comparing all pairs."""
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_query_equals_brute_force(spark, sf_dir, texts):
    prints = {i: fingerprint(t) for i, t in texts.items()}
    want = classes(prints, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in s.op4_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_tiles_lose_no_link(spark, monkeypatch):
    """Chains of fingerprints one and two bits apart, in tiles of every number of parts and in many blocks."""
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            rows.append(x)
            for _ in range(rng.randrange(0, 5)):
                x ^= 1 << rng.randrange(64)
    prints = dict(enumerate(rows))
    want = classes(prints, 2)
    frame = spark.createDataFrame([(i, s._signed(x), 0) for i, x in prints.items()], "id long, l0 long, size long")
    for parts in (1, 2, 4, 16):
        monkeypatch.setattr(s, "parts_for", lambda rows, radius, bits, parts=parts: parts)
        monkeypatch.setattr(s, "BLOCK", 16)
        labels = {r.id: r.label for r in s.components(s.tiled_links(frame, 1, 2)).collect()}
        assert {i: labels.get(i, i) for i in prints} == want


def test_steps_name_every_pair_of_tiles_once():
    for parts, radius in ((1, 2), (2, 2), (4, 2)):
        found = s.steps(parts, radius)
        assert len(set(found)) == len(found)
        both = set(found) | {tuple(-x for x in d) for d in found}
        want = {d for d in np.ndindex(*[2 * radius + 1] * parts)}
        want = {tuple(x - radius for x in d) for d in want if sum(abs(x - radius) for x in d) <= radius}
        assert both == want and len(found) == (len(want) + 1) // 2


def test_tiles_shrink_with_the_rows():
    """The expected comparisons of a row with the tiles near it stay bounded while rows grow a millionfold."""
    for rows in (10**4, 10**6, 10**8, 10**10):
        parts = s.parts_for(rows, 2)
        meet = (math.comb(128 // parts, 64 // parts) / 4 ** (64 // parts)) ** parts
        assert rows * meet * len(s.steps(parts, 2)) < 3_000_000
    assert s.parts_for(10, 2) == 1 and s.parts_for(10**9, 44, 128) == 1


def test_many_lanes_do_not_wrap():
    """Random texts differ in about half of 512 bits; sums of bits over 255 mustn't start anew."""
    lanes = np.random.default_rng(3).integers(0, 1 << 63, (8, 300), dtype=np.uint64)
    lanes[:, 7] = lanes[:, 250]
    a, b = s.block_links((np.arange(300), lanes, np.ones(300, np.int64)), None, 20, 0.0)
    assert (a.tolist(), b.tolist()) == ([7], [250])


def test_majority_of_many():
    h = np.random.default_rng(1).integers(0, 1 << 63, 100_000, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert s.majority(h) == want


def test_odd_rows(odd_docs, no_docs):
    out = s.simhash_classes(odd_docs).collect()
    assert len(out) == odd_docs.count()
    empty = {r.component for r in out if r.lanes == [0]}
    assert len(empty) == 1
    assert s.simhash_classes(no_docs).count() == 0


def copies(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(300)] for _ in range(8)]
    rows, group = [], {}
    for n, words in enumerate(base):
        for k in range(6):
            near = list(words)
            for _ in range(k // 2):
                near[rng.randrange(300)] = word()
            group[len(rows)] = n
            rows.append((len(rows), " ".join(near), "en", "s", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), group


def test_one_of_each_group_stays(spark, odd_docs, no_docs):
    docs, group = copies(spark)
    kept = [r.doc_id for r in s.keep_one(docs).collect()]
    assert sorted(kept) == [6 * n for n in range(8)]
    out = s.keep_one(odd_docs)
    assert out.columns == odd_docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and 14 not in ids
    assert s.keep_one(no_docs).count() == 0
    same = docs.withColumn("text", F.lit("one text in all the rows there are"))
    assert [r.doc_id for r in s.keep_one(same).collect()] == [0]


def shingle_sets(texts, k=5):
    return {i: {" ".join(w[n : n + k]) for n in range(max(1, len(w) - k + 1))} for i, w in ((i, t.lower().split()) for i, t in texts.items())}


def jaccard_winners(texts, ratio=0.8):
    """Smallest ids of the classes by comparing all pairs of shingle sets."""
    sets, parent = shingle_sets(texts), {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= round(5 * ratio) * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in ids if root(i) == i}


def pairs_of_similarity():
    """Pairs that share n - r of n shingles each: 0.7, 0.8, 0.85; four shingles of five; and texts beside themselves twice."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = []
    for shingles, r in ((170, 30), (180, 20), (185, 15), (179, 21)):
        for _ in range(40):
            words = [word() for _ in range(shingles + 4)]
            texts += [" ".join(words), " ".join(words[:-r] + [word() for _ in range(r)])]
    for _ in range(40):
        words = [word() for _ in range(9)]
        texts += [" ".join(words), " ".join(words[:-1])]
    for _ in range(10):
        words = [word() for _ in range(60)]
        texts += [" ".join(words), " ".join(words * 2)]
    return dict(enumerate(texts))


def test_stage_equals_brute_force_about_the_threshold(spark, monkeypatch):
    texts = pairs_of_similarity()
    want = jaccard_winners(texts)
    assert len(texts) - len(want) == 40 + 40 + 40 + 10
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in s.keep_one(docs).select("doc_id").collect()} == want
    monkeypatch.setattr(s, "BLOCK", 16)
    monkeypatch.setattr(s, "CELLS", 512)
    assert {r.doc_id for r in s.keep_one(docs).select("doc_id").collect()} == want


def test_stage_equals_brute_force_on_documents(spark, texts, documents):
    kept = {r.doc_id for r in s.keep_one(documents).select("doc_id").collect()}
    assert kept == jaccard_winners({i: t or "" for i, t in texts.items()})
