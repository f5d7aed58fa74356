"""Importance resampling towards a target's distribution of hashed words.

A text is folded to lower case and single spaces about its words. The distinct words of a batch of texts, each
with a space on either side, become an Aho-Corasick dictionary whose payloads are the word's CRC-32 and length;
one scan of a text emits the payloads of its words in order. The checksum of a run of words follows from the
payloads of its neighbours alone, so longer runs are never spelled out. Checksums modulo the number of buckets are
counted for all documents and for the target; the log ratios of both, summed over a document's runs, are its weight,
and Gumbel noise keyed by its id turns the highest sums into a draw without replacement.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .common import shared_folder, small_batches, stash, table, unused

#: Fixed values of the query: runs of this many words at most, buckets, seed, per cent drawn, fewest words of a drawn document.
LONGEST, BUCKETS, SEED, PER_CENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20

FEATURES = "struct<n_words:bigint,buckets:array<int>>"
_ARROW = pa.struct([("n_words", pa.int64()), ("buckets", pa.list_(pa.int32()))])
#: Bytes of a text in UTF-8: letters a-z, digits and all beyond ASCII stay, A-Z are folded, others are spaces.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Byte lengths of words beyond 2 to this power don't occur in an Arrow string.
_POWERS = 32


@functools.cache
def _shift_tables() -> np.ndarray:
    """[power, byte of the checksum, its value]: what a checksum becomes when 2**power zero bytes follow, by its four bytes."""
    tables = np.zeros((_POWERS, 4, 256), np.uint32)
    unit = [zlib.crc32(b"\0", 0xFFFFFFFF ^ (1 << bit)) ^ zlib.crc32(b"\0", 0xFFFFFFFF) for bit in range(32)]
    columns = np.array(unit, np.uint32)
    for power in range(_POWERS):
        for byte in range(4):
            for bit in range(8):
                has = (np.arange(256) >> bit & 1).astype(bool)
                tables[power, byte, has] ^= columns[8 * byte + bit]
        columns = _shifted_once(tables[power], columns)
    return tables


def _shifted_once(parts: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return parts[0][crc & 255] ^ parts[1][crc >> 8 & 255] ^ parts[2][crc >> 16 & 255] ^ parts[3][crc >> 24]


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of left and right one after the other, from theirs and the byte length of the right ones."""
    tables, out = _shift_tables(), left.copy()
    for power in range(int(length.max(initial=0)).bit_length()):
        has = (length >> power & 1).astype(bool)
        out[has] = _shifted_once(tables[power], out[has])
    return out ^ right


class Dictionary:
    """The distinct words of some texts as an automaton; scan() gives the payloads of a text's words."""

    def __init__(self, words: set[bytes]):
        import ahocorasick

        listed = list(words)
        self.crc = np.array([zlib.crc32(w) for w in listed], np.uint32)
        self.length = np.array([len(w) for w in listed], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, word in enumerate(listed):
            self.automaton.add_word(f" {word.decode('latin-1')} ", n)
        if listed:
            self.automaton.make_automaton()
        # What a space before the word adds to its payload.
        self.spaced = joined_crc(np.full(len(listed), zlib.crc32(b" "), np.uint32), self.crc, self.length)

    def scan(self, line: str) -> np.ndarray:
        return np.fromiter((n for _, n in self.automaton.iter(line)), np.int64) if len(self.crc) else np.zeros(0, np.int64)

    def buckets(self, line: str, longest: int, buckets: int) -> tuple[int, np.ndarray]:
        """Number of words, and the buckets of all runs of up to `longest` of them, shorter runs first."""
        at = self.scan(line)
        run, found = self.crc[at], []
        for k in range(min(longest, len(at))):
            if k:
                run = joined_crc(run[:-1], self.spaced[at[k:]], self.length[at[k:]] + 1)
            found.append(run % np.uint32(buckets))
        return len(at), np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)


def text_buckets(texts: list[bytes | None], longest: int, buckets: int) -> list[tuple[int, np.ndarray]]:
    split = [(t or b"").translate(_FOLD).split() for t in texts]
    dictionary = Dictionary(set().union(*split))
    return [dictionary.buckets(f" {b' '.join(words).decode('latin-1')} ", longest, buckets) for words in split]


def bucket_column(text: Column, longest: int, buckets: int) -> Column:
    """FEATURES of a text: the number of words and a bucket for each run."""

    def features(texts: pa.Array) -> pa.Array:
        found = text_buckets(texts.cast(pa.binary()).to_pylist(), longest, buckets)
        ends = np.cumsum([0, *(len(b) for _, b in found)])
        flat = np.concatenate([np.zeros(0, np.int32), *(b for _, b in found)])
        return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], fields=list(_ARROW))

    return F.arrow_udf(features, FEATURES)(text)


def count_buckets(rows: DataFrame, column: str, buckets: int) -> np.ndarray:
    """How often each bucket occurs in an array column of all rows; a task sends `buckets` sums at most, as the driver gets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for at, n in rows.select(F.col(column).alias("buckets")).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[at] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's share of each bucket to the source's, both with one added, rounded down."""
    everything, aimed, buckets = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (everything + buckets) / ((s + 1.0) * (aimed + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def summed(buckets: Column, gains: np.ndarray) -> Column:
    """The sum of the gains of an array of buckets."""

    def weigh(rows: pa.Array) -> pa.Array:
        ends = rows.offsets.to_numpy().astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(gains[rows.flatten().to_numpy(zero_copy_only=False)])])
        return pa.array(sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]], pa.int64())

    return F.arrow_udf(weigh, "bigint")(buckets)


def noise(id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the id's digest, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: int = SEED, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of docs; rank, from 1 on, of those drawn and null for others.

    Of the rows with at least least_words words, per_cent in a hundred are drawn, rounded down: the highest scores, of equal ones the
    smaller id, nulls after all others. target has a column of the name `text` too. Each text is scanned once; its
    buckets, two bytes a word or so, are written to the shared folder and read for counting and for the sums. Null and empty texts have
    no words and weigh 0; null ids share one noise; repeated rows are rows of their own, so each may be drawn. An empty table gives no rows; an
    empty target gives weights from the documents alone. Other columns play no part.
    """
    shared_folder(docs.sparkSession)
    scanned = stash(docs.select(F.col(id).alias("id"), bucket_column(F.col(text), longest, buckets).alias("f")).select("id", "f.n_words", "f.buckets"), "resampling")
    aimed = target.select(bucket_column(F.col(text), longest, buckets).alias("f")).select("f.buckets")
    gains = bucket_gains(count_buckets(scanned, "buckets", buckets), count_buckets(aimed, "buckets", buckets))
    weighed = scanned.select("id", "n_words", F.size("buckets").cast("long").alias("n_features"), summed(F.col("buckets"), gains).alias("weight"))
    scored = stash(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "resampling-scores")
    fits = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    drawn = scored.where(fits).count() * per_cent // 100
    placed = numbered(scored.where(fits), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight"), F.col("n_words")], "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    out = placed.unionByName(scored.where(~fits).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id), "n_words", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that importance() draws, all columns as they are, in no order. Repeated ids stay or go together; null ids go."""
    id = options.get("id", "doc_id")
    (key,) = unused(docs, "drawn")
    drawn = importance(docs, target, **options).where("rank is not null").select(F.col(id).alias(key)).distinct()
    return docs.join(drawn, F.col(id) == F.col(key), "left_semi")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards `benchmark`, and the rank of those drawn."""
    small_batches(spark)
    found = importance(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: Checksums by the definition of CRC-32: a byte is mixed in, then eight steps to the right, with the reversed polynomial where a bit falls out.
OP11_SQL = """WITH w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
  b AS (SELECT UNNEST(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
  e AS (SELECT doc_id, UNNEST(words) AS word FROM w),
  v AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM e UNION SELECT word FROM b) t),
  c AS (SELECT word, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS UBIGINT))),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: 0::UBIGINT)), lambda r, bit: xor(r >> 1, 3988292384::UBIGINT * (r & 1::UBIGINT)))), 4294967295::UBIGINT) % 10000 AS BIGINT) AS bucket FROM v),
  s AS (SELECT bucket, COUNT(*) AS n FROM e JOIN c USING (word) GROUP BY bucket), t AS (SELECT bucket, COUNT(*) AS n FROM b JOIN c USING (word) GROUP BY bucket),
  g AS (SELECT s.bucket, CAST(FLOOR(1000 * LN((COALESCE(t.n, 0) + 1.0E0) * ((SELECT COUNT(*) FROM e) + 10000.0E0) / ((s.n + 1.0E0) * ((SELECT COUNT(*) FROM b) + 10000.0E0)))) AS BIGINT) AS gain FROM s LEFT JOIN t ON t.bucket = s.bucket),
  q AS (SELECT doc_id, CAST(SUM(gain) AS BIGINT) AS weight FROM e JOIN c USING (word) JOIN g USING (bucket) GROUP BY doc_id),
  r AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_features, COALESCE(weight, 0) AS weight, COALESCE(weight, 0) + CAST(FLOOR(-1000 * LN(-LN((CAST('0x' || substr(sha256('2024:' || w.doc_id), 1, 8) AS UBIGINT) + 0.5E0) / 4294967296.0E0))) AS BIGINT) AS score FROM w LEFT JOIN q ON q.doc_id = w.doc_id),
  p AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY score DESC, doc_id) AS place, COUNT(*) OVER () * 10 // 100 AS drawn FROM r WHERE n_features >= 20)
  SELECT r.doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM r LEFT JOIN p ON p.doc_id = r.doc_id"""
