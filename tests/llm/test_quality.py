import math
import re
from collections import Counter

from pyspark.sql import functions as F

from shutterloom.llm import quality as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_query_equals_brute_force(spark, sf_dir, texts):
    for r in q.op7_quality_rules(spark, sf_dir).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_repeated_words_in_odd_sequences():
    for words in ([], ["a"] * 7, ["a"] * 8, ["a"] * 9, ["a"] * 20, list("abcdefghabcdefgh"), list("abcdefghXabcdefgh"), list("abcdefgabcdefg")):
        assert q.repeated_words(words) == brute(" ".join(words))[4]


def at_most(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_bound_is_exact():
    for n in (1, 7, 100, 1000):
        for p in (0.005, 0.03, 0.4):
            for k in range(int(n * p) + 1):
                if k < n * p:
                    assert math.isclose(q.at_most(k, n, p), at_most(k, n, p), rel_tol=1e-9)
            assert q.within_risk(n, n, p, 0.05) is False
    assert not q.within_risk(0, 0, 0.03, 0.05) and q.within_risk(0, 1000, 0.03, 0.05)
    # Many labels cost no more than a multiple of the root of the mean.
    assert q.within_risk(4_900_000, 1_000_000_000, 0.005, 1e-3) and not q.within_risk(4_999_999, 1_000_000_000, 0.005, 1e-3)


def test_verdicts_equal_a_recomputation(spark, sf_dir, documents):
    """Cutoffs chosen label by label and bound by the plain sum, verdicts row by row."""
    rows = {r.doc_id: r for r in documents.collect()}
    ratios = {i: {rule: (m[q.MEASURES.index(a)] / m[q.MEASURES.index(b)] if m[q.MEASURES.index(b)] else 0.0) for rule, (a, b) in q.RULES.items()} for i, m in ((i, q.measure(r.text)) for i, r in rows.items())}
    stratum = {i: r.lang if r.lang in q.STRATA else "other" for i, r in rows.items()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality in (0, 1) and r.doc_id in rows]
    level, limit, cutoffs = 0.05 / (5 * 6), 0.03 / 6, {}
    for s in set(stratum.values()):
        for rule in q.RULES:
            good = [ratios[i][rule] for i, x in labels if stratum[i] == s and x == 1]
            bad = [ratios[i][rule] for i, x in labels if stratum[i] == s and x == 0]
            for cutoff in q.CUTOFFS[rule]:
                a, b = sum(x > cutoff for x in good), sum(x > cutoff for x in bad)
                if not good or a >= limit * len(good) or at_most(a, len(good), limit) > level:
                    break
                if b > a and b * len(good) > 3 * a * len(bad):
                    cutoffs[s, rule] = cutoff
    got = {r.doc_id: r.kept for r in q.op7_quality_rules(spark, sf_dir).collect()}
    for i, r in rows.items():
        n_words, _, _, _, covered = brute(r.text)
        want = not (n_words < 20 or 100 * covered > 30 * n_words or any(ratios[i][rule] > cutoffs.get((stratum[i], rule), math.inf) for rule in q.RULES))
        assert got[i] == want


def test_cutoffs_hold_the_risk():
    """A rule that parts good from bad is used up to the cutoff that its bound allows; one without evidence isn't."""
    n = len(q.CUTOFFS["symbols"])
    many = {("en", "symbols", 0): (5000, 0), ("en", "symbols", n): (0, 400), ("de", "symbols", 0): (40, 0), ("de", "symbols", n): (0, 40)}
    chosen = q.choose_cutoffs(many)
    assert chosen == {("en", "symbols"): q.CUTOFFS["symbols"][-1]}
    noisy = {("en", "symbols", k): (100, 100) for k in range(n + 1)}
    assert q.choose_cutoffs(noisy) == {}
    rising = {("en", "symbols", k): (2000 if k == 0 else 3, 50) for k in range(n + 1)}
    cutoff = q.choose_cutoffs(rising).get(("en", "symbols"))
    level = q.ERROR / (5 * len(q.RULES))
    if cutoff is not None:
        k = q.CUTOFFS["symbols"].index(cutoff)
        assert q.within_risk(3 * (k + 1), 2000 + 3 * n, q.RISK / len(q.RULES), level)


def test_stage(spark, documents, sf_dir, odd_docs, no_docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = q.keep_good(documents, labels)
    assert out.columns == documents.columns
    kept = {r.doc_id for r in q.op7_quality_rules(spark, sf_dir).where("kept").collect()}
    assert {r.doc_id for r in out.collect()} == kept
    odd = q.keep_good(odd_docs, labels.limit(0))
    assert odd.columns == odd_docs.columns and all(len(r.text.split()) >= 20 for r in odd.collect())
    assert q.keep_good(no_docs, labels).count() == 0
    null_labels = labels.select("doc_id", F.lit(None).cast("int").alias("quality"))
    assert q.keep_good(documents, null_labels).count() > 0
