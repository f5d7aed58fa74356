import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers

from shutterloom.llm import packing as p
from tests.llm.test_token_counts import plain

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_hilbert_visits_every_cell_by_neighbours():
    for dims, bits in ((2, 3), (3, 2), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        at = p.hilbert(cells, bits)
        assert sorted(at.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_query(spark, sf_dir, texts):
    encode = plain()
    pieces, sequences = defaultdict(list), defaultdict(list)
    rows = p.op10_packing(spark, sf_dir).collect()
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    for i, own in pieces.items():
        ids = [*encode(texts[i]), 0]
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    lengths = []
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        lengths.append(sum(r.length for r in own))
    assert max(lengths) == 1024 and sum(x < 1024 for x in lengths) == 1
    assert sorted(rows) == sorted(p.op10_packing(spark, sf_dir).collect())


def test_many_partitions(spark, documents, monkeypatch):
    monkeypatch.setattr(p, "PARTITION_BYTES", 30_000)
    got = p.pack(documents, PATH).groupBy("sequence_id").sum("length").collect()
    lengths = [r[1] for r in got]
    assert max(lengths) == 1024 and 1 < sum(x < 1024 for x in lengths) < 40


def test_copies_lie_together_and_spread(spark):
    """Near texts are near on the curve; a hot text's ids still tell its rows apart."""
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdef"), 5))
    base = [" ".join(word() for _ in range(200)) for _ in range(20)]
    texts = [t + f" tail{k}" for t in base for k in range(3)]
    keys = p.curve_keys(list(range(60)), texts) >> p.SALT
    near = np.abs(keys.reshape(20, 3) - keys.reshape(20, 3)[:, :1])[:, 1:].mean()
    assert near < np.abs(np.diff(rng.permutation(keys))).mean() / 3
    assert len(set(p.curve_keys(list(range(1000)), ["hot"] * 1000).tolist())) == 1000


def test_odd_rows(spark, odd_docs, no_docs):
    got = p.pack(odd_docs, PATH)
    assert got.groupBy("doc_id").count().count() == odd_docs.select("doc_id").distinct().count()
    assert got.where("doc_tokens = 1").count() == 3
    assert p.pack(no_docs, PATH).count() == 0
