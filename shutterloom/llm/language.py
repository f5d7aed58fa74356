"""Language by Bayesian evidence fusion.

The text's likelihood under a byte-trigram model of each language, the language that the markup
declares, and a prior for the host are multiplied. The host's prior is smoothed towards the one of
its address suffix, and that towards the global one; these, and how often each language is
declared as each, come from grouped sums of the texts' own verdicts; a row whose text says nothing has none.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stash, table, unused

LANGUAGES = ("de", "en", "es", "fr")
#: A document whose id's checksum is a multiple of this is held out of training.
FOLDS = 5
BINS = 1 << 13
#: Trigrams of a text count as so many independent ones at most: neighbours say the same.
EFFECTIVE = 60.0
#: Pseudo-counts that the wider level lends to the narrower one.
HOST_STRENGTH, SUFFIX_STRENGTH, DECLARED_STRENGTH = 4.0, 20.0, 10.0

_HIDDEN = re.compile(r"<(script|style)\b", re.I)
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}


def visible(markup: str | None) -> str:
    """Text of a page without scripts, styles, comments and tags, entities decoded.

    One walk over the signs that open: what was searched for an end in vain isn't searched again, so unclosed tags take no longer.
    An unclosed script, style or comment goes like any tag, up to the next ">"; a "<" without one stays.
    """
    text, out, at, vain = markup or "", [], 0, set()

    def after(kind: str, start: int) -> int | None:
        if kind in vain:
            return None
        if kind in _CLOSING:
            found = _CLOSING[kind].search(text, start)
            end = found.end() if found else -1
        else:
            end = text.find(kind, start) + len(kind) if text.find(kind, start) >= 0 else -1
        if end < 0:
            vain.add(kind)
        return end if end >= 0 else None

    while (open_ := text.find("<", at)) >= 0:
        hidden = _HIDDEN.match(text, open_)
        end = after(hidden[1].lower(), hidden.end()) if hidden else after("-->", open_ + 4) if text.startswith("<!--", open_) else None
        if end is None:
            end = after(">", open_ + 1)
        if end is None:
            break
        out += [text[at:open_], " "]
        at = end
    return html.unescape("".join([*out, text[at:]]))


def trigram_bins(text: str | None) -> np.ndarray:
    """How often each of BINS hashed trigrams of the lower-cased letters occurs; white space and digits are one space."""
    plain = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()) + " "
    data = np.frombuffer(plain.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.zeros(BINS, np.int64)
    for at in range(0, max(0, len(data) - 2), 1 << 18):
        part = data[at : at + (1 << 18) + 2].astype(np.uint32)
        mixed = (part[:-2] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA77) + part[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(19)
        count += np.bincount(mixed, minlength=BINS)
    return count


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> np.ndarray:
    """Log probabilities (languages, BINS) from all rows whose language is one of LANGUAGES.

    Each task sends at most languages x BINS counts, and the driver gets as many sums.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(LANGUAGES), BINS), np.int64)
        for batch in batches:
            for own, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                sums[LANGUAGES.index(own)] += trigram_bins(t)
        at, bins = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bins, pa.int32()), pa.array(sums[at, bins], pa.int64())], ["lang", "bin", "n"])

    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isin(*LANGUAGES))
    sums = np.ones((len(LANGUAGES), BINS))
    for at, b, n in rows.mapInArrow(count, "lang int, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n")).collect():
        sums[at, b] += n
    return np.log(sums / sums.sum(axis=1, keepdims=True))


def _likelihoods(model: np.ndarray, markup: bool):
    def scores(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            bins = trigram_bins(visible(t) if markup else t)
            n = bins.sum()
            hit = np.flatnonzero(bins)
            total = model[:, hit] @ bins[hit] * (min(n, EFFECTIVE) / n if n else 0.0)
            out.append(total - total.max())
        return pa.array([x.tolist() for x in out], pa.list_(pa.float64()))

    return F.arrow_udf(scores, "array<double>")


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host without user and port, in lower case, and its last label; null where there is no host."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(found != "", found)
    return host, F.when(host.isNotNull(), F.element_at(F.split(host, r"\."), -1))


def declared_language(markup: Column) -> Column:
    """The primary tag of the first html element's lang attribute, lower-case; null if there is none."""
    found = F.lower(F.regexp_extract(markup, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1))
    return F.when(found != "", found)


def _best(scores: Column) -> Column:
    """The language of the highest score, the first of several; null where all are equal."""
    top = F.element_at(F.array(*map(F.lit, LANGUAGES)), F.array_position(scores, F.array_max(scores)).cast("int"))
    return F.when(F.array_max(scores) > F.array_min(scores), top)


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % FOLDS == 0


def _sums(names: list[str]) -> list[Column]:
    return [F.sum((F.col("text_lang") == lang).cast("long")).alias(name) for lang, name in zip(LANGUAGES, names, strict=True)]


def fuse(evidence: DataFrame) -> DataFrame:
    """evidence (likelihoods, declared, host, suffix and any others) with text_lang, lang, probability.

    A row's own verdict is left out of its host's and suffix's counts. Null or equal likelihoods, as of an empty
    text, are no verdict: text_lang is null, and the row counts for no host, suffix or declaration. No host: the global
    prior; no declaration, or one that is none of LANGUAGES: no evidence from it. A tie of everything, as in an empty
    table's prior, gives the first language. Repeated rows count each. Other columns stay as they are, whatever their names; text_lang, lang and
    probability are replaced. Sums are made before the shuffle, so a hot host is a row a task; hosts join
    back on the host, spread by AQE where one is hot.
    """
    none = F.array(*[F.lit(0.0)] * len(LANGUAGES))
    kept = [c for c in evidence.columns if c not in ("text_lang", "lang", "probability")]
    rows = evidence.select(*kept).withColumn("likelihoods", F.coalesce("likelihoods", none)).withColumn("text_lang", _best(F.col("likelihoods")))
    names = unused(rows, "by_host", "by_suffix", "posterior", *(f"{by}_{x}" for by in ("h", "s") for x in LANGUAGES))
    by_host, by_suffix, posterior, of_host, of_suffix = *names[:3], names[3 : 3 + len(LANGUAGES)], names[3 + len(LANGUAGES) :]
    overall = {x: n for x, n in rows.where("text_lang is not null").groupBy("text_lang").count().collect()}
    all_rows = sum(overall.values())
    base = {x: (overall.get(x, 0) + 1.0) / (all_rows + len(LANGUAGES)) for x in LANGUAGES}
    said = {(a, b): n for a, b, n in rows.where(F.col("declared").isin(*LANGUAGES)).groupBy("text_lang", "declared").count().collect()}
    # Written, so that the joins deal both sides themselves and AQE can split a hot host's side.
    hosts = stash(rows.where("host is not null").groupBy(F.col("host").alias(by_host)).agg(*_sums(of_host)), "language-hosts")
    suffixes = stash(rows.where("suffix is not null").groupBy(F.col("suffix").alias(by_suffix)).agg(*_sums(of_suffix)), "language-suffixes")
    met = rows.join(hosts, F.col("host") == F.col(by_host), "left").join(suffixes, F.col("suffix") == F.col(by_suffix), "left")
    own = {x: F.coalesce((F.col("text_lang") == x).cast("double"), F.lit(0.0)) for x in LANGUAGES}

    def level(columns: list[str], x: str, strength: float, wider: Column) -> Column:
        n = lambda y: F.coalesce(F.col(columns[LANGUAGES.index(y)]) - own[y], F.lit(0.0))
        return (n(x) + strength * wider) / (sum((n(y) for y in LANGUAGES), F.lit(0.0)) + strength)

    total = []
    for k, x in enumerate(LANGUAGES):
        prior = level(of_host, x, HOST_STRENGTH, level(of_suffix, x, SUFFIX_STRENGTH, F.lit(base[x])))
        seen = sum(said.get((x, d), 0) for d in LANGUAGES)
        given = F.lit(0.0)
        for d in LANGUAGES:
            p = (said.get((x, d), 0) + DECLARED_STRENGTH * (0.7 if d == x else 0.1)) / (seen + DECLARED_STRENGTH)
            given = F.when(F.col("declared") == d, F.lit(math.log(p))).otherwise(given)
        total.append(F.col("likelihoods")[k] + F.log(prior) + given)
    logs = F.array(*total)
    fused = met.withColumn(posterior, logs)
    share = 1 / F.aggregate(posterior, F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max(posterior)))
    return fused.select(*kept, "text_lang", F.coalesce(_best(F.col(posterior)), F.lit(LANGUAGES[0])).alias("lang"), share.alias("probability"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page, and of every document taken as plain text on a host named by its source.

    Pages have a page_id, documents a doc_id; the other is null. The text models come from the documents that are not
    held_out; a document declares nothing, as its `lang` is what is to be found.
    """
    small_batches(spark)
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    host, suffix = address_parts(F.col("url"))
    none = F.lit(None)
    of_pages = pages.select(F.lit("page").alias("kind"), "page_id", none.cast("long").alias("doc_id"), none.cast("boolean").alias("held_out"), declared_language(F.col("html")).alias("declared"), host.alias("host"), suffix.alias("suffix"), _likelihoods(model, True)("html").alias("likelihoods"))
    of_docs = docs.select(F.lit("document").alias("kind"), none.cast("long").alias("page_id"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), none.cast("string").alias("declared"), F.concat(F.lit("source:"), "source").alias("host"), none.cast("string").alias("suffix"), _likelihoods(model, False)("text").alias("likelihoods"))
    evidence = stash(of_pages.unionByName(of_docs), "language")
    return fuse(evidence).select("kind", "page_id", "doc_id", "lang", F.round("probability", 6).alias("probability"), "text_lang", "declared", "held_out")
