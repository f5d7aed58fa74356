import itertools
import random
import re
from collections import defaultdict

import pytest

from shutterloom.llm import filter_audit

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(rows, names):
    """The audit by walking every order over the rows (part, failing letters, good, toxic)."""
    parts = defaultdict(list)
    for part, *rest in rows:
        parts[part].append(rest)
    out = []
    for part, held in parts.items():
        shapley, found = defaultdict(int), []
        for order in itertools.permutations(names):
            left = held
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = [r for r in held if f in r[0]]
                shapley[f] += len(gone)
                found.append([part, "".join(order), k + 1, len(left), len(gone), len(failing) - len(gone), sum(r[0] == {f} for r in held), sum(r[1] for r in gone), sum(r[2] for r in gone), f])
        out += [(*x[:-1], shapley[x[-1]]) for x in found]
    return sorted(out, key=repr)


def failing(docs):
    """(id, part, letters) by the definitions of the five filters."""
    out = []
    for id, part, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        tests["E"] = id is not None and any((t or "") == text and i is not None and i < id for i, _, t in docs)
        out.append((id, part or "", {k for k, v in tests.items() if v}))
    return out


def rows_of(found):
    assert found.columns == list(COLUMNS)
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("seed", range(30))
def test_merges(seed):
    chosen = random.Random(seed)
    lists = [sorted(chosen.sample(range(400), chosen.choice([0, 1, 5, 60, 390]))) for _ in range(chosen.randint(0, 6))]
    assert filter_audit.union(lists) == sorted(set().union(*lists))
    for a, b in itertools.permutations(lists, 2):
        assert filter_audit.difference(a, b) == sorted(set(a) - set(b))


def test_gallop():
    ids = list(range(0, 200, 3))
    for start in (0, 5, 66):
        for bound in range(-1, 210):
            want = next((k for k in range(start, len(ids)) if ids[k] >= bound), len(ids))
            assert filter_audit.gallop(ids, start, bound) == want


@pytest.mark.parametrize("names", ["A", "XYZ", "ABCDE"])
def test_audit_equals_brute_force(spark, names):
    chosen = random.Random(7)
    rows = [(chosen.choice(["hot"] * 8 + ["b", None, ""]), i // 2, chosen.randrange(1 << len(names)), chosen.randrange(4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "part string, id bigint, failing int, marks int").selectExpr("*", "'clash' AS filter", "1 AS prefix", "2 AS removed")
    want = brute([(p, {x for k, x in enumerate(names) if f >> k & 1}, m & 1, m >> 1) for p, _, f, m in rows], names)
    assert rows_of(filter_audit.audit(df, names)) == want


def test_documents_equal_brute_force(spark, sf_dir, documents):
    docs = [(r.doc_id, r.source, r.text) for r in documents.collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marks = {r.doc_id: (r.quality == 1, r.toxic == 1) for r in labels.collect()}
    want = brute([(part, letters, *marks.get(id, (False, False))) for id, part, letters in failing(docs)], "ABCDE")
    assert rows_of(filter_audit.op12_filter_audit(spark, sf_dir)) == want


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 0), (1000, 1, 1)], "doc_id bigint, quality int, toxic int")
    docs = [(r.doc_id, r.source, r.text) for r in odd_docs.select("doc_id", "source", "text").collect()]
    marks = {1: (True, True), 99: (True, False)}
    want = brute([(part, letters, *marks.get(id, (False, False))) for id, part, letters in failing(docs)], "ABCDE")
    assert rows_of(filter_audit.audit(filter_audit.failures(odd_docs, labels), "ABCDE")) == want
    assert filter_audit.audit(filter_audit.failures(no_docs, labels), "ABCDE").count() == 0
    empty = filter_audit.audit(filter_audit.failures(odd_docs, labels.limit(0)), "ABCDE")
    assert empty.agg({"good_lost": "sum"}).first()[0] == 0


def test_null_bits(spark):
    rows = spark.createDataFrame([("p", 1, None, None), ("p", None, 1, 3)], "part string, id bigint, failing int, marks int")
    assert rows_of(filter_audit.audit(rows, "A")) == [("p", "A", 1, 1, 1, 0, 1, 1, 1, 1)]
    with pytest.raises(ValueError):
        filter_audit.audit(rows, "ABCDEFG")
