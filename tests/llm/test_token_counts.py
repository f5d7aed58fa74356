import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shutterloom.llm import token_counts as c
from shutterloom.llm import tokens
from shutterloom.llm.common import shared_folder

CHANGES = "change string, source string, lang string, tokenizer string, tokens bigint, old_tokens bigint"


def names(ledger):
    return sorted(r.batch for r in ledger.committed().collect())


def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_segments_give_the_ids_of_whole_texts(texts):
    encode = plain()
    rng = random.Random(2)
    odd = ["", None, " ", "  a b", "a\n b", " a", "a ", "don't  stop <|endoftext|> x", " x y", "日本 語　x y", "a!! b?! ..c d... e'... f$$$ '!! x", "é. ü, ß!", "1,2 3. 4!"]
    odd += ["x×y", "a\x00b \x1c c", "\x1c", "\x1d \x1e", "\n", "a\n", "\na"]
    odd += ["".join(rng.choice("ab1é .,!'\n\t #$\xa0\u2003\u3000ß×日🙂\r\x1cs") for _ in range(rng.randrange(60))) for _ in range(3000)]
    rows = [*odd, *texts.values()]
    want = [encode(t) for t in rows]
    small, usual = (tokens.SegmentTokenizer(public_tokenizers.path("byte_bpe_50k.json"), **x) for x in ({"keep": 500, "at_once": 3000}, {}))
    for by in (small, small, usual):
        got = by.ids(pa.array(["left out", *rows]).slice(1)).to_pylist()
        for ids, own, text in zip(got, want, rows, strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == own, repr(text)
    assert len(usual.ids(pa.array([], pa.string()))) == 0


def test_query_equals_recomputation(spark, sf_dir, documents):
    encode, want = plain(), defaultdict(lambda: [0, 0])
    rows = documents.orderBy("doc_id").collect()
    seen = set()
    for r in rows:
        if (r.text or "") in seen:
            continue
        seen.add(r.text or "")
        text = r.text or ""
        once = "\n".join(dict.fromkeys(text.split("\n")))
        text = once if len(once) < len(text) else text
        for name, n in (("byte_bpe_50k", len(encode(text))), ("words", len(text.split()))):
            want[r.source, r.lang, name][0] += 1
            want[r.source, r.lang, name][1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in c.op8_token_counts(spark, sf_dir).collect()}
    assert got == dict(want)


def test_batches_commit_once(spark, tmp_path):
    ledger = c.TokenLedger(spark, str(tmp_path / "ledger"))
    assert ledger.rollup().count() == 0
    batch = spark.createDataFrame([("insert", "s", "en", "t", 5, None), ("insert", None, None, "t", None, None), ("insert", "s", "en", "t", 7, 0)], CHANGES)
    assert ledger.commit("a", batch) and not ledger.commit("a", batch)
    assert ledger.commit("b", spark.createDataFrame([("revise", "s", "en", "t", 9, 7), ("delete", "s", "en", "t", 5, None), ("delete", None, None, "t", None, None)], CHANGES))
    assert [tuple(r) for r in ledger.rollup().collect()] == [("s", "en", "t", 1, 9)]
    assert ledger.commit("empty", batch.limit(0)) and names(ledger) == ["a", "b", "empty"]
    with pytest.raises(Exception, match="no such change"):
        ledger.commit("c", spark.createDataFrame([("burn", "s", "en", "t", 1, None)], CHANGES))
    assert names(ledger) == ["a", "b", "empty"]
    with pytest.raises(ValueError):
        ledger.commit("../x", batch)


def test_compaction_keeps_totals_and_names(spark, tmp_path):
    ledger = c.TokenLedger(spark, str(tmp_path / "ledger"))
    assert not ledger.compact()
    one = lambda n: spark.createDataFrame([("insert", "s", "en", "t", n, None)], CHANGES)
    for n in range(3):
        ledger.commit(f"a{n}", one(n + 1))
    assert ledger.compact() and not ledger.compact()
    ledger.sweep()
    assert sorted(x.name for x in (tmp_path / "ledger").iterdir()) == ["_total-1"]
    assert names(ledger) == ["a0", "a1", "a2"] and not ledger.commit("a1", one(9))
    assert ledger.commit("b", one(10)) and ledger.compact()
    assert [tuple(r) for r in ledger.rollup().collect()] == [("s", "en", "t", 4, 16)]
    ledger.sweep()
    assert [tuple(r) for r in ledger.rollup().collect()] == [("s", "en", "t", 4, 16)] and names(ledger) == ["a0", "a1", "a2", "b"]


def test_the_second_writer_changes_nothing(spark, tmp_path):
    """Another writer puts the batch in place after this one has looked for it."""
    folder = tmp_path / "ledger"
    ledger, other = c.TokenLedger(spark, str(folder)), c.TokenLedger(spark, str(folder))
    rows = spark.createDataFrame([("insert", "s", "en", "t", 5, None)], CHANGES)
    ledger.is_committed = lambda batch: False
    assert other.commit("x", rows)
    assert not ledger.commit("x", rows)
    assert sorted(p.name for p in folder.iterdir()) == ["x"] and other.rollup().first().tokens == 5


def test_half_written_batches_do_not_count(spark, tmp_path):
    folder = tmp_path / "ledger"
    (folder / "_writing-x").mkdir(parents=True)
    (folder / "y").mkdir()
    assert names(c.TokenLedger(spark, str(folder))) == []
    assert shared_folder(spark)


def test_random_histories(spark, tmp_path):
    rng, live, ledger = random.Random(9), {}, c.TokenLedger(spark, str(tmp_path / "ledger"))
    for n in range(4):
        rows = []
        for i in range(200):
            if i in live and rng.random() < 0.5:
                key, old = live.pop(i)
                if rng.random() < 0.5:
                    live[i] = (key, rng.randrange(9))
                    rows.append(("revise", *key, live[i][1], old))
                else:
                    rows.append(("delete", *key, old, None))
            elif i not in live:
                live[i] = ((rng.choice("ab"), rng.choice(["en", None]), "t"), rng.randrange(9))
                rows.append(("insert", *live[i][0], live[i][1], None))
        ledger.commit(f"b{n}", spark.createDataFrame(rows, CHANGES))
    docs, total = Counter(k for k, _ in live.values()), Counter()
    for k, x in live.values():
        total[k] += x
    assert {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in ledger.rollup().collect()} == {k: (docs[k], total[k]) for k in docs}


def test_odd_changes(spark, tmp_path, odd_docs, no_docs):
    """Null keys and counts, repeated rows, other columns of clashing names, and tables without rows."""
    ledger = c.TokenLedger(spark, str(tmp_path / "ledger"))
    counted = odd_docs.select("*", F.lit("insert").alias("change"), F.lit("t").alias("tokenizer"), F.length("text").alias("tokens"), F.lit(None).cast("bigint").alias("old_tokens"), F.lit(7).alias("docs"))
    assert ledger.commit("odd", counted)
    want = defaultdict(lambda: [0, 0])
    for r in odd_docs.collect():
        want[r.source, r.lang][0] += 1
        want[r.source, r.lang][1] += len(r.text or "")
    assert {(r.source, r.lang): [r.docs, r.tokens] for r in ledger.rollup().collect()} == dict(want)
    empty = no_docs.select("*", F.lit("delete").alias("change"), F.lit("t").alias("tokenizer"), F.lit(1).alias("tokens"), F.lit(0).alias("old_tokens"))
    assert ledger.commit("none", empty) and ledger.rollup().count() == len(want)
    gone = counted.withColumn("change", F.lit("delete"))
    assert ledger.commit("gone", gone) and ledger.rollup().count() == 0 and ledger.compact() and ledger.rollup().count() == 0
    assert not ledger.commit("odd", counted) and names(ledger) == ["gone", "none", "odd"]
