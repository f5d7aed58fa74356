import math
import random
import time

import pytest
from pyspark.sql import functions as F

from shutterloom.llm import toxicity as t


def test_folding():
    assert t.words("1d10t IDIOT іdiоt m0r0n l@zy ｃｌｏｗｎ 2024 idiot*** a$$$ wow! $5 a | b") == ["idiot", "idiot", "idiot", "moron", "lazy", "clown", "idiot", "asss", "wow", "a", "b"]
    assert t.words("i\u200bdiot $cum st\u0301upid tr@$h") == ["idiot", "scum", "stupid", "trash"]


def test_disguised_entries_are_found():
    """Every built-in entry, with each letter that has one replaced by a digit, sign or look-alike, or parted by unseen characters."""
    lexicon = t.Lexicon({})
    other = {}
    for disguise, letter in [*zip(t.SUBSTITUTES, t.LETTERS, strict=True), *zip(t.LOOKALIKES, t.LATIN, strict=True)]:
        other.setdefault(letter, []).append(disguise)
    for word in t.SEED_WORDS:
        plain = lexicon.score(f"so {word} then")
        assert plain > 0
        assert lexicon.score("so " + "\u200b".join(word) + " then") == lexicon.score(f"so {word.upper()} then") == plain
        for at, letter in enumerate(word):
            for disguise in other.get(letter, []):
                if disguise not in "!|" or 0 < at < len(word) - 1:
                    assert lexicon.score(f"so {word[:at]}{disguise}{word[at + 1 :]} then") == plain, (word, disguise)


def naive_score(text, weights):
    """Every entry tried at every place of the line of words; an entry within an exception phrase doesn't count."""
    found = t.words(text)
    line, total = " " + " ".join(found) + " ", 0.0
    entries = {f" {w} ": t.SEED_WEIGHT for w in t.SEED_WORDS} | weights
    phrases = [(i, i + len(p) + 2) for p in t.EXCEPTIONS for i in range(len(line)) if line.startswith(f" {p} ", i)]
    for at in range(len(line)):
        if not any(a <= at < b - 1 for a, b in phrases):
            total += max((w for e, w in entries.items() if line.startswith(e, at)), default=0.0)
    return total / math.log2(8 + len(found))


def test_automaton_equals_a_naive_matcher(texts):
    rng = random.Random(4)
    weights = {" the": 1.5, " der ": 2.0, " an": 0.5, " and ": 3.25, " pondering ": 1.0, " un": 0.25}
    lexicon = t.Lexicon(weights)
    odd = [" ".join(rng.choice([*t.SEED_WORDS, *t.EXCEPTIONS, "the", "and", "fish", "can", "der", "pond", "x"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    for text in [*odd, *list(texts.values())[:60]]:
        assert lexicon.score(text) == pytest.approx(naive_score(text, weights), abs=1e-12)


def test_lexicon_weighs_words_beginnings_and_exceptions():
    lexicon = t.Lexicon({" vequ": 4.0, " vequa ": 6.0})
    base = lexicon.score("nothing here")
    assert base == 0
    assert lexicon.score("vequist") > 0 and lexicon.score("unvequ") == 0
    assert lexicon.score("vequa x") > lexicon.score("vequi x")
    assert lexicon.score("the clown fish swims") == 0 < lexicon.score("the clown swims")
    assert lexicon.score("idiot") > lexicon.score("idiot " + "word " * 500) > 0
    assert lexicon.score(None) == lexicon.score("") == 0


def test_terms_are_weighed_by_evidence():
    got = t.weigh({" awful ": 90, " the ": 99, " awfully ": 30, " awfu": 120, " rare ": 1}, {" the ": 980}, 130, 1000)
    assert set(got) == {" awfu"}
    assert set(t.weigh({" awful ": 90, " awfu": 91}, {}, 130, 1000)) == {" awful "}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = t.score_toxicity(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where(t.held_out(F.col("doc_id")))
    got = {(r.toxic, r.hit): r["count"] for r in rows.groupBy("toxic", (F.col("score") >= 0.5).alias("hit")).count().collect()}
    hits, missed, wrong, clean = (got.get(x, 0) for x in ((1, True), (1, False), (0, True), (0, False)))
    assert hits / (hits + missed) > 0.85 and wrong / (wrong + clean) < 0.01


def test_labels_of_the_held_out_fold_change_nothing(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lied = labels.withColumn("toxic", F.when(t.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda x: {r.doc_id: r.score for r in t.score_toxicity(documents, x).select("doc_id", "score").collect()}
    assert score(labels) == score(lied)


def test_odd_rows(spark, odd_docs, no_docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = t.score_toxicity(odd_docs, labels)
    assert out.count() == odd_docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert t.score_toxicity(odd_docs, labels.limit(0)).where("score >= 0.5").count() == 0
    assert t.score_toxicity(no_docs, labels).count() == 0


def test_time_grows_with_the_text():
    lexicon = t.Lexicon({" clown ": 2.0})
    for unit in ("clown fish ", "clown ", "clown fish idiot ", "pond scum soap scum "):
        text = unit * (5_000_000 // len(unit))
        start = time.process_time()
        score = lexicon.score(text)
        assert time.process_time() - start < 20 and (score > 0) == (unit in ("clown ", "clown fish idiot "))


def test_excused_places_equal_a_plain_search():
    chosen = random.Random(3)
    for _ in range(300):
        best = {chosen.randrange(60): chosen.random() for _ in range(chosen.randrange(12))}
        excused = [(a, a + chosen.randrange(12)) for a in (chosen.randrange(60) for _ in range(chosen.randrange(8)))]
        want = sum(w for at, w in best.items() if not any(a <= at < b for a, b in excused))
        assert t._unexcused(best, excused) == pytest.approx(want)
