"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, look-alike letters to Latin ones, digits and signs inside
words to the letters they stand for. An Aho-Corasick automaton then finds all lexicon entries in
one pass: whole words and word beginnings with the log-odds learned from labelled documents,
beside a short built-in list, and exception phrases within which an entry doesn't count. The sum
of the weights, divided by a slowly growing function of the length, goes through a logistic curve
fitted to the same documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stash, table

#: Letters that look like the Latin letters below them.
LOOKALIKES = "аеорсухіјѕһԁɡνοαρτυκιвмнтк" + "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
LATIN = "aeopcyxijshdgvoaptukibmhtk" + "abcdefghijklmnopqrstuvwxyz"
#: Digits and signs that stand for letters inside words.
SUBSTITUTES = "01345679@$!|8"
LETTERS = "oieastggasilb"
#: Entries without labelled evidence, and phrases in which an entry means no insult.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown")
EXCEPTIONS = (
    ("clown fish", "clown car", "clown nose", "class clown", "rodeo clown", "circus clown", "birthday clown")
    + ("trash can", "trash bin", "trash bag", "trash bags", "trash collection", "trash compactor", "take out the trash", "the trash folder")
    + ("pond scum", "soap scum", "scum line", "sore loser rule", "loser bracket", "loser of the match", "winner and loser")
    + ("stupid easy", "stupid simple", "the idiot by", "idiot proof", "an idiot s guide", "idiot light", "oxy moron")
    + ("pathetic fallacy", "worthless stock", "worthless securities", "expire worthless", "expired worthless")
)
SEED_WEIGHT = 3.0
#: Labelled rows that are learned from, at most: those whose ids hash lowest. Their ids are broadcast.
MOST_LABELLED = 20_000
#: Entries that are learned at most; the lexicon is broadcast, so this bounds it.
MOST_TERMS = 20_000
#: A term is weighed if this share of the toxic training documents have it, and at least so many.
LEAST_SHARE, LEAST_COUNT = 0.004, 5
#: The lower end of a term's log-odds (2.6 standard errors below) that makes it an entry.
LEAST_ODDS = 1.0
PREFIXES = (4, 5, 6, 7, 8)
#: A beginning is left out if one longer entry has this share of the documents that have it: it stands for that one.
STANDS_FOR = 0.9
FOLDS = 5

_FOLD = str.maketrans(LOOKALIKES, LATIN)
_LOOKALIKE = re.compile(f"[{LOOKALIKES}]")
_DIGITS = str.maketrans(SUBSTITUTES, LETTERS)
#: Zero-width characters, soft hyphens and accents that combine: they part no word.
_UNSEEN = re.compile("[\u00ad\u034f\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff\u0300-\u036f]+")
#: @ and $ stand for letters anywhere in a word but alone; ! and | only between others, as they also end words.
_SIGNS = re.compile(r"[@$]+(?=[^\W\d_])|(?<=[^\W\d_])[@$]+|(?<=[^\W_])[!|]+(?=[^\W_])")
_WITH_DIGIT = re.compile(r"[^\W_]*[01345-9][^\W_]*")
_DIGIT = re.compile("[01345-9]")
_WORD = re.compile(r"[^\W\d_]+")
#: The same, of texts in ASCII, which are in lower case by then.
_ASCII_WORD = re.compile("[a-z]+")


def _letters(m: re.Match) -> str:
    return m[0].translate(_DIGITS) if _WORD.search(m[0]) else m[0]


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        text = _UNSEEN.sub("", text.translate(_FOLD) if _LOOKALIKE.search(text) else text)
    if any(sign in text for sign in "@$!|"):
        text = _SIGNS.sub(_letters_of_sign, text)
    return _WITH_DIGIT.sub(_letters, text) if _DIGIT.search(text) else text


def _letters_of_sign(m: re.Match) -> str:
    return m[0].translate(_DIGITS)


def words(text: str | None) -> list[str]:
    folded = fold(text or "")
    return (_ASCII_WORD if folded.isascii() else _WORD).findall(folded)


def terms(text: str | None) -> set[str]:
    """Candidate entries of a text: its words, " so ", and their beginnings, " so"."""
    out = set()
    for w in set(words(text)):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if len(w) > k)
    return out


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % FOLDS == 0


def _count_terms(rows: DataFrame, only: frozenset | None) -> DataFrame:
    """(term, n): rows with the term, counted within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for text in batch.column("text"):
                found = terms(text.as_py())
                seen.update(found if only is None else found & only)
                if len(seen) > 100_000:
                    yield out()
                    seen.clear()
        yield out()

    return rows.select("text").mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def weigh(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries and weights from document counts: of a word and its beginnings, the shortest that isn't only another's beginning."""
    found = {}
    longest = {}
    for term, n in toxic.items():
        for k in PREFIXES:
            if k + 1 < len(term):
                longest[term[: k + 1]] = max(longest.get(term[: k + 1], 0), n)
    for term in sorted(toxic, key=lambda t: (len(t.rstrip()), t)):
        if not term.endswith(" ") and longest.get(term, 0) >= STANDS_FOR * toxic[term]:
            continue
        a, b = toxic[term] + 0.5, clean.get(term, 0) + 0.5
        odds = math.log(a / (n_toxic + 1)) - math.log(b / (n_clean + 1))
        if odds - 2.6 * math.sqrt(1 / a + 1 / b) < LEAST_ODDS:
            continue
        if any(found.get(term[: k + 1], 0) >= odds - 0.5 for k in PREFIXES if k + 1 < len(term.rstrip())):
            continue
        found[term] = round(min(odds, 8.0), 6)
    return found


class Lexicon:
    """Weighted entries with exception phrases; score(text) is the length-normalised sum."""

    def __init__(self, weights: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for w in SEED_WORDS:
            weights = {f" {w} ": SEED_WEIGHT} | weights
        for term, weight in weights.items():
            self.automaton.add_word(term, (weight, len(term)))
        for phrase in EXCEPTIONS:
            self.automaton.add_word(f" {phrase} ", (0.0, len(phrase) + 2))
        self.automaton.make_automaton()

    def score(self, text: str | None) -> float:
        found = words(text)
        line = " " + " ".join(found) + " "
        best: dict[int, float] = {}
        excused = []
        for end, (weight, length) in self.automaton.iter(line):
            start = end - length + 1
            if weight:
                best[start] = max(best.get(start, 0.0), weight)
            else:
                excused.append((start, end))
        return _unexcused(best, excused) / math.log2(8 + len(found))


def _unexcused(best: dict[int, float], excused: list[tuple[int, int]]) -> float:
    """The sum of the weights whose places no excused span holds; places and spans are walked together."""
    total, spans, end = 0.0, iter(sorted(excused)), -1
    ahead = next(spans, None)
    for at in sorted(best):
        while ahead is not None and ahead[0] <= at:
            end, ahead = max(end, ahead[1]), next(spans, None)
        if at >= end:
            total += best[at]
    return total


def fit_curve(bins: list[tuple[float, int, int]], n_toxic: int, n_clean: int) -> tuple[float, float]:
    """Intercept and slope of the logistic curve by Newton steps with a small penalty. bins: (score, toxic, clean)."""
    base = math.log((n_toxic + 0.5) / (n_clean + 0.5))
    if not n_toxic or not n_clean:
        return min(base, -2.0), 2.0
    x = np.array([b[0] for b in bins])
    y, n = np.array([b[1] for b in bins], float), np.array([b[1] + b[2] for b in bins], float)
    design = np.stack([np.ones_like(x), x], 1)
    theta = np.array([base, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (y - n * p) - 1e-2 * theta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        theta = theta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(max(theta[1], 0.1))


def learn(labelled: DataFrame) -> tuple[dict[str, float], tuple[float, float]]:
    """Lexicon weights and curve from rows (text, toxic in 0 and 1).

    The driver gets MOST_TERMS counts at most, and the scores rounded to 1000 steps.
    """
    sizes = dict(labelled.groupBy("toxic").count().collect())
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    least = max(LEAST_COUNT, math.ceil(LEAST_SHARE * n_toxic))
    often = _count_terms(labelled.where("toxic = 1"), None).where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(MOST_TERMS)
    toxic = dict(often.collect()) if n_toxic else {}
    clean = dict(_count_terms(labelled.where("toxic = 0"), frozenset(toxic)).collect()) if toxic and n_clean else {}
    weights = weigh(toxic, clean, n_toxic, n_clean)
    scored = labelled.select("toxic", F.round(F.least(raw_score(weights)(F.col("text")), F.lit(50.0)), 1).alias("x"))
    bins = scored.groupBy("x").agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).collect()
    return weights, fit_curve([tuple(b) for b in bins], n_toxic, n_clean)


def raw_score(weights: dict[str, float]):
    def score(text: pa.Array) -> pa.Array:
        lexicon = _lexicon(weights)
        return pa.array([lexicon.score(t) for t in text.to_pylist()], pa.float64())

    return F.arrow_udf(score, "double")


_built: dict = {}


def _lexicon(weights: dict[str, float]) -> Lexicon:
    key = hash(frozenset(weights.items()))
    if key not in _built:
        _built.clear()
        _built[key] = Lexicon(weights)
    return _built[key]


def score_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", to: str = "score") -> DataFrame:
    """docs with `to`: how likely label 1 is, from 0 to 1, from the text alone.

    labels (doc_id, toxic): rows of ids whose checksum falls into the held-out fold are not learned from,
    nor are null labels; contradictory ones count each. Of the others MOST_LABELLED are learned from, a
    sample by hash, so that no text is shuffled for it. Null and empty texts score as texts without entries.
    """
    marked = labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias(id), "toxic")
    sample = marked.orderBy(F.xxhash64(id, F.lit(13)), id, "toxic").limit(MOST_LABELLED)
    labelled = stash(docs.select(id, F.col(text).alias("text")).join(F.broadcast(sample), id).select("text", "toxic"), "toxicity")
    weights, (intercept, slope) = learn(labelled)
    raw = raw_score(weights)(F.col(text))
    return docs.withColumn(to, 1 / (1 + F.exp(-(F.lit(intercept) + slope * raw))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
