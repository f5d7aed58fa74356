import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from shutterloom.llm import quality, secret_scan
from shutterloom.llm.common import stash

from .test_simhash import jaccard_winners

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def goals(sizes):
    """Words that the mix wants of each source: a share of all by weight, what exceeds twice a source's size shared anew by weight."""
    names = sorted(sizes)
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if level * weight[n] > 2 * sizes[n]}
        for n in full or open_:
            out[n] = 2.0 * sizes[n] if full else level * weight[n]
        left -= sum(out[n] for n in full)
        open_ = open_ - full if full else set()
    return out


def is_part(part, whole):
    """Whether the words of part come in whole in this order."""
    rest = iter(whole)
    return all(w in rest for w in part)


def test_each_stage_equals_brute_force_on_its_input(spark, sf_dir, documents):
    tables = [documents]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stash(stage(spark, tables[-1], sf_dir), name))
    rows = [t.collect() for t in tables]
    good = {r.doc_id for r in quality.op7_quality_rules(spark, sf_dir).where("kept").collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if r.doc_id in good)
    first = jaccard_winners({r.doc_id: r.text or "" for r in rows[1]})
    assert sorted(rows[2]) == sorted(r for r in rows[1] if r.doc_id in first)
    clean = {r.doc_id: secret_scan.redact_text(r.text) for r in rows[2]}
    assert {r.doc_id: r.text for r in rows[3]} == clean and all(r.n_chars == len(r.text) for r in rows[3])
    words = {r.doc_id: WORD.findall(r.text) for r in rows[3]}
    sizes, taken, passes = Counter(), Counter(), Counter()
    source = {r.doc_id: r.source for r in rows[3]}
    for i, w in words.items():
        sizes[source[i]] += len(w)
    for r in rows[4]:
        own = WORD.findall(r.text)
        assert own and is_part(own, words[r.doc_id]) and r.n_chars == len(r.text) and r.source == source[r.doc_id]
        assert r.text == clean[r.doc_id] or r.text == " ".join(own)
        taken[r.source] += len(own)
        passes[r.doc_id] += 1
    assert max(passes.values()) <= 2
    want = goals(sizes)
    assert all(abs(taken[n] - want[n]) <= 1 for n in want)
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode.encode_special_tokens = True
    ids = defaultdict(list)
    for r in rows[4]:
        ids[r.doc_id].append([*encode.encode(r.text, add_special_tokens=False).ids, 0])
    sequences, held = Counter(), Counter()
    for r in rows[5]:
        assert any(len(x) == r.doc_tokens and np.frombuffer(r.ids, "<u2").tolist() == x[r.start : r.start + r.length] for x in ids[r.doc_id])
        sequences[r.sequence_id] += r.length
        held[r.doc_id] += r.length
    assert held == {i: sum(map(len, own)) for i, own in ids.items()}
    assert max(sequences.values()) == 1024 and sum(n < 1024 for n in sequences.values()) == 1


def test_stages(spark, sf_dir, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stash(stage(spark, docs, sf_dir), name)
        assert docs.columns == documents.columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
    rows = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in rows.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secrets", "mixture", "packed"]


def test_stages_bear_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == docs.columns
    for docs in (odd_docs, no_docs):
        kept = docs
        for _, stage in corpus_pipeline.STAGES:
            kept = stash(stage(spark, kept, sf_dir), "odd")
