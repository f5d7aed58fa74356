"""Quality rules with risk-controlled thresholds.

Every text is measured once. Each rule compares one ratio of these measures with a cutoff. The
cutoffs are chosen on labelled documents, for each stratum (language) and rule: from the laxest
cutoff on, the share of good documents that the rule would reject is bounded above by the exact
binomial (Clopper-Pearson) bound, and the cutoff moves on as long as the bound stays within the
allowed risk. Testing the cutoffs in that fixed order needs no correction among them; among
strata and rules the error level is divided (Bonferroni). A rule without enough evidence in a
stratum rejects nothing there.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stash, table, unused

#: Languages with a stratum of their own; all others, and null, share "other".
STRATA = ("de", "en", "es", "fr")
#: Good documents that the calibrated rules together may reject, by stratum; each rule has an even part of it. The base
#: rules are given, so what they reject is no part of it.
RISK = 0.03
#: Chance that any of the bounds fails.
ERROR = 0.05
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
_TYPE = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"

#: Rule -> (measure, per measure); all reject high ratios.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "capitals": ("n_upper", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "long_words": ("word_chars", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
#: Cutoffs of each rule from lax to strict.
CUTOFFS = {
    "symbols": tuple(round(3.0 * 0.85**k, 4) for k in range(30)),
    "capitals": tuple(round(0.9 * 0.9**k, 4) for k in range(30)),
    "marks": tuple(round(2.0 * 0.85**k, 4) for k in range(30)),
    "long_words": tuple(round(30 * 0.94**k, 3) for k in range(30)),
    "dup_lines": tuple(round(0.9 * 0.9**k, 4) for k in range(30)),
    "repeats": tuple(round(0.3 * 0.9**k, 4) for k in range(30)),
}

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_MARK = re.compile(r"[!?]")


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words covered by windows of `window` words that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    # Equal windows have equal rolling values, so distinct values settle that nothing repeats.
    rolling = np.zeros(n, np.uint64)
    for k in range(window):
        rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
    order = np.argsort(rolling, kind="stable")
    same = rolling[order][1:] == rolling[order][:-1]
    if not same.any():
        return 0
    twin = np.zeros(n, bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    starts = np.flatnonzero(twin).tolist()
    listed = ids.tolist()
    count = Counter(tuple(listed[i : i + window]) for i in starts)
    edge = np.zeros(len(words) + 1, np.int64)
    for i in starts:
        if count[tuple(listed[i : i + window])] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES; all 0 for null and empty texts."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(_SYMBOL.findall(text)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text)),
        len(_MARK.findall(text)),
    )


def _measured(text: pa.Array) -> pa.Array:
    columns = list(zip(*map(measure, text.to_pylist()), strict=True)) or [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))


def with_measures(docs: DataFrame, text: str = "text", to: str = "measures") -> DataFrame:
    """docs with a struct column `to` of MEASURES, replacing one of that name."""
    return docs.withColumn(to, F.arrow_udf(_measured, _TYPE)(F.col(text)))


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit("other"))


def ratio(rule: str, measures: str = "measures") -> Column:
    """The rule's ratio, 0 where its divisor is 0."""
    top, per = (F.col(f"{measures}.{x}") for x in RULES[rule])
    return F.when(per > 0, top / per).otherwise(F.lit(0.0))


def _passed(rule: str) -> Column:
    """How many of the rule's cutoffs lie below its ratio."""
    value = ratio(rule)
    return F.size(F.filter(F.array(*map(F.lit, CUTOFFS[rule])), lambda c: c < value))


def at_most(rejected: int, of: int, share: float) -> float:
    """Exact binomial probability of so few rejections or fewer, if each of `of` has probability `share`; 1 from the mean on up.

    Below the mean the terms shrink from the last one down, the faster the further, so only those that still count
    are summed: some multiple of the root of the mean, however many labels there are.
    """
    if rejected >= of * share:
        return 1.0
    k, total, term = rejected, 1.0, 1.0
    while k > 0 and term > 1e-17 * total:
        term *= k * (1 - share) / ((of - k + 1) * share)
        total += term
        k -= 1
    log = math.lgamma(of + 1) - math.lgamma(rejected + 1) - math.lgamma(of - rejected + 1) + rejected * math.log(share) + (of - rejected) * math.log1p(-share)
    return min(1.0, math.exp(log + math.log(total)))


def within_risk(rejected: int, of: int, risk: float, level: float) -> bool:
    """Whether the exact binomial (Clopper-Pearson) upper bound of the rejected share, with error `level`, is at most the risk.

    The bound is the share at which so few rejections have probability `level`, so it lies within the risk if
    they have no more than that at the risk itself: one test, no search for the bound.
    """
    return of > 0 and at_most(rejected, of, risk) <= level


def choose_cutoffs(counts: dict[tuple[str, str, int], tuple[int, int]], risk: float = RISK, error: float = ERROR) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> cutoff. counts: (stratum, rule, n) -> (good, bad) labelled documents whose ratio lies above n of the rule's cutoffs."""
    level = error / ((len(STRATA) + 1) * len(RULES))
    chosen = {}
    for s in (*STRATA, "other"):
        for rule, cutoffs in CUTOFFS.items():
            steps = [counts.get((s, rule, k), (0, 0)) for k in range(len(cutoffs) + 1)]
            good, bad = (sum(x[i] for x in steps) for i in (0, 1))
            found = None
            for k, cutoff in enumerate(cutoffs):
                over_good, over_bad = (sum(x[i] for x in steps[len(cutoffs) - k :]) for i in (0, 1))
                if not within_risk(over_good, good, risk / len(RULES), level):
                    break
                # A stricter cutoff has to catch more bad documents than good ones.
                if over_bad > over_good and over_bad * good > 3 * over_good * bad:
                    found = cutoff
            if found is not None:
                chosen[s, rule] = found
    return chosen


def calibrate(measured: DataFrame, labels: DataFrame, id: str = "doc_id", lang: str = "lang", risk: float = RISK, error: float = ERROR) -> dict[tuple[str, str], float]:
    """Cutoffs from measured documents joined with labels (doc_id, quality: 1 good, 0 bad, null ignored).

    The driver gets at most strata x rules x 31 pairs of counts. Contradictory labels count each.
    """
    marked = labels.where("quality in (0, 1)").select(F.col("doc_id").alias(id), "quality")
    held = measured.select(id, stratum(F.col(lang)).alias("stratum"), "measures").join(marked, id)
    above = F.array(*(F.struct(F.lit(rule).alias("rule"), _passed(rule).alias("n")) for rule in RULES))
    rows = held.select("stratum", "quality", F.explode(above).alias("x")).groupBy("stratum", "x.rule", "x.n").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    return choose_cutoffs({(s, rule, n): (good, bad) for s, rule, n, good, bad in rows.collect()}, risk, error)


def base_failed(measures: str = "measures") -> Column:
    words, repeats = F.col(f"{measures}.n_words"), F.col(f"{measures}.n_repeat_words")
    return (words < 20) | (100 * repeats > 30 * words)


def kept(cutoffs: dict[tuple[str, str], float], lang: str = "lang") -> Column:
    """False if the base rules fail or a chosen rule rejects."""
    bad = base_failed()
    for (s, rule), cutoff in sorted(cutoffs.items()):
        bad |= (stratum(F.col(lang)) == s) & (ratio(rule) > cutoff)
    return ~bad


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject, with their own columns only.

    Texts are measured once: the rows are written with their measures, as that is cheaper than to measure
    twice, and no text is shuffled. Null and empty texts fail. A null language is judged in the stratum "other".
    """
    (aside,) = unused(docs, "__measures")
    measured = stash(with_measures(docs.withColumnRenamed("measures", aside)), "quality")
    cutoffs = calibrate(measured.select("doc_id", "lang", "measures"), labels)
    return measured.where(kept(cutoffs)).drop("measures").withColumnRenamed(aside, "measures").select(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    small_batches(spark)
    measured = stash(with_measures(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text"), "quality")
    cutoffs = calibrate(measured, table(spark, sf_dir, "labels"))
    return measured.select("doc_id", *(f"measures.{m}" for m in MEASURES[:5]), base_failed().alias("base_failed"), kept(cutoffs).alias("kept"), stratum(F.col("lang")).alias("stratum"))
