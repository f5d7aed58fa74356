"""Audit of how filters interact: what each removes, alone and behind others, in every order.

The rows are dealt by part and id, so that a task holds ranges of ids. Within a range each filter has a sorted
posting list of the rows that fail it, by their place in the range. For every set of filters that may come first,
a galloping merge of their lists is the union of what they remove; for every other filter the difference of its list to
that union is what it removes then, and the overlaps with the lists of marked rows say how many good ones go. The sizes
of all ranges are summed; orders are put together from the sums.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, small_batches, stash, table

#: Parts that a task sums at once; beyond, it sends what it has.
MOST_PARTS = 512
_SUMS = ("removed", "good", "toxic", "united", "failing", "total")
_SCHEMA = "part string, prefix int, filter int, " + ", ".join(f"{x} bigint" for x in _SUMS)


def gallop(ids: list[int], start: int, bound: int) -> int:
    """The first place from start on whose id is at least bound: steps that double, then a search within the last."""
    step, low = 1, start
    while start + step < len(ids) and ids[start + step] < bound:
        low, step = start + step, 2 * step
    return bisect_left(ids, bound, low, min(len(ids), start + step + 1))


def union(lists: list[list[int]]) -> list[int]:
    """What any of the sorted lists holds, in order: a run of the list with the lowest head is taken up to the next lowest head."""
    out: list[int] = []
    open_ = [[x, 0] for x in lists if x]
    while len(open_) > 1:
        open_.sort(key=lambda x: x[0][x[1]])
        (first, at), (second, other) = open_[0], open_[1]
        bound = second[other]
        end = gallop(first, at, bound)
        out += first[at:end]
        # The bound itself comes from the second list, so an equal one here is passed over.
        open_[0][1] = end + (end < len(first) and first[end] == bound)
        if open_[0][1] == len(first):
            open_.pop(0)
    for rest, at in open_:
        out += rest[at:]
    return out


def difference(ids: list[int], without: list[int]) -> list[int]:
    """What of the first sorted list the second lacks, in order."""
    out: list[int] = []
    i = j = 0
    while i < len(ids) and j < len(without):
        if ids[i] < without[j]:
            end = gallop(ids, i, without[j])
            out += ids[i:end]
            i = end
        elif ids[i] == without[j]:
            i, j = i + 1, j + 1
        else:
            j = gallop(without, j, ids[i])
    return out + ids[i:]


def range_sums(failing: np.ndarray, marks: np.ndarray, filters: int) -> np.ndarray:
    """[prefix, filter, _SUMS] of the rows of one part in one range; failing and marks are bit sets by row, marks of good (1) and toxic (2)."""
    bits = lambda values, bit: np.flatnonzero(values >> bit & 1).tolist()
    lists, good, toxic = [bits(failing, f) for f in range(filters)], bits(marks, 0), bits(marks, 1)
    sums = np.zeros((1 << filters, filters, len(_SUMS)), np.int64)
    for prefix in range(1 << filters):
        gone = union([lists[f] for f in range(filters) if prefix >> f & 1])
        for f in range(filters):
            if not prefix >> f & 1:
                removed = difference(lists[f], gone)
                held = [len(removed) - len(difference(removed, marked)) for marked in (good, toxic)]
                sums[prefix, f] = (len(removed), *held, len(gone) + len(removed), len(lists[f]), len(failing))
    return sums


def _merge(filters: int):
    def rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        at = [(p, f) for p in range(1 << filters) for f in range(filters) if not p >> f & 1]
        columns = [[part for part in sums for _ in at], [p for _ in sums for p, _ in at], [f for _ in sums for _, f in at]]
        values = np.array([s[p, f] for s in sums.values() for p, f in at], np.int64).reshape(-1, len(_SUMS))
        types = (pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), *(pa.array(v, pa.int64()) for v in values.T)], ["part", "prefix", "filter", *_SUMS])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            parts, failing, marks = batch.column("part").to_pylist(), batch.column("failing").to_numpy(), batch.column("marks").to_numpy()
            start = 0
            while start < len(parts):
                end = start + 1
                while end < len(parts) and parts[end] == parts[start]:
                    end += 1
                found = range_sums(failing[start:end], marks[start:end], filters)
                sums[parts[start]] = sums.get(parts[start], 0) + found
                start = end
            if len(sums) >= MOST_PARTS:
                yield rows(sums)
                sums = {}
        yield rows(sums)

    return merge


def audit(rows: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, each order of the filters and each step.

    rows (part, id, failing, marks): failing has bit n set where the row fails the n-th of names, one letter a filter and six at most,
    as the orders are all permutations; marks has bit 0 for good, bit 1 for toxic rows. All four are counted within the part.
    A part of any size is cut by ids over many tasks. Repeated and null ids are rows of their own; a null part is one of its own and
    comes as null; null bit sets fail nothing and mark nothing; extra columns play no part; no rows give none.
    """
    n = len(names)
    if not 1 <= n <= 6:
        raise ValueError("from one filter to six")
    zero = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c)
    plain = rows.select(F.col("part").cast("string").alias("part"), "id", zero("failing"), zero("marks"))
    ranges = plain.repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("part", "failing", "marks")
    merged = ranges.mapInArrow(_merge(n), _SCHEMA).groupBy("part", "prefix", "filter").agg(*(F.sum(x).alias(x) for x in _SUMS))
    sums = stash(merged, "filter-audit")
    # How many orders have just this set before a filter, by the set's size; and whether it is all others.
    before = F.bit_count("prefix")
    orders_with = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), before + 1)
    whole = sums.groupBy(F.col("part").alias("p"), F.col("filter").alias("f")).agg(F.sum(F.col("removed") * orders_with).alias("shapley"), F.max(F.when(before == n - 1, F.col("removed"))).alias("unique_fails"))
    steps = [("".join(order), k + 1, sum(1 << names.index(x) for x in order[:k]), names.index(order[k])) for order in itertools.permutations(names) for k in range(n)]
    orders = F.broadcast(rows.sparkSession.createDataFrame(steps, "filter_order string, step int, prefix int, filter int"))
    met = sums.join(whole, F.col("part").eqNullSafe(F.col("p")) & (F.col("filter") == F.col("f"))).join(orders, ["prefix", "filter"])
    return met.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.col("united")).alias("kept"),
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails",
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
    )


def short_text(words: Column) -> Column:
    return F.size(words) < 50


def poor_text(words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < 65 * F.size(words)


def loud_text(text: Column) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text)


def signed_text(text: Column) -> Column:
    return text.rlike("[#$%&*|]")


def failures(docs: DataFrame, labels: DataFrame, part: str = "source", id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, id, failing, marks) of docs for audit(), by the filters A to E.

    A: under 50 words; B: fewer than 65 distinct words in a hundred; C: over 5 capitals in a hundred code points; D: one of the signs
    #$%&*|; E: a text that a smaller id has too, anywhere in the table. Null texts count as empty, null parts as empty strings. A row of a null id
    is never a copy, and has no labels. Of repeated ids none is smaller, so equal texts of one id are no copies of each other. labels (doc_id,
    quality, toxic) mark a document if any of its labels does. Texts are read once; what is joined has 60 bytes a row, and only digests that occur twice are joined.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(plain, F.lit(f"({WORD_PATTERN})"), F.lit(1))
    bits = lambda *tests: sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    split = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(id).alias("id"), plain.alias("text"), words.alias("words"))
    read = split.select("part", "id", bits(short_text(F.col("words")), poor_text(F.col("words")), loud_text(F.col("text")), signed_text(F.col("text"))).alias("failing"), F.unhex(F.sha2("text", 256)).alias("digest"))
    read = stash(read, "filter-rows")
    firsts = stash(read.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "filter-copies")
    copies = read.join(firsts, "digest", "left").select("part", "id", F.when(F.col("id") > F.col("first"), F.col("failing") + 16).otherwise(F.col("failing")).alias("failing"))
    marked = labels.groupBy(F.col("doc_id").alias("id")).agg((F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))) + 2 * F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)))).alias("marks"))
    return copies.join(marked.where("marks > 0"), "id", "left").select("part", "id", "failing", "marks")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the five filters over all documents by source."""
    small_batches(spark)
    rows = failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(rows, "ABCDE")


OP12_SQL = """WITH w AS (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
  c AS (SELECT doc_id, part, CAST(len(words) < 50 AS INT) AS fa, CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT) AS fb, CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS INT) AS fc,
    CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS fd, CAST(doc_id > MIN(doc_id) OVER (PARTITION BY text) AS INT) AS fe FROM w),
  f AS (SELECT part, fa + 2 * fb + 4 * fc + 8 * fd + 16 * fe AS mask, CAST(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS INT) AS good, CAST(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS INT) AS toxic FROM c),
  m AS (SELECT part, mask, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM f GROUP BY part, mask),
  d AS (SELECT UNNEST(['A', 'B', 'C', 'D', 'E']) AS letter, UNNEST([1, 2, 4, 8, 16]) AS bit),
  p AS (SELECT a.letter || b.letter || x.letter || y.letter || z.letter AS filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] AS bits FROM d a, d b, d x, d y, d z WHERE a.bit + b.bit + x.bit + y.bit + z.bit = 31 AND LEN(LIST_DISTINCT([a.bit, b.bit, x.bit, y.bit, z.bit])) = 5),
  o AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, COALESCE(list_sum(bits[1:step - 1]), 0) AS prefix FROM p, (SELECT UNNEST(range(1, 6)) AS step) k),
  r AS (SELECT part, filter_order, step, bit, CAST(SUM(n) FILTER (WHERE mask & (prefix + bit)::INT = 0) AS BIGINT) AS kept, CAST(SUM(n) FILTER (WHERE mask & bit > 0 AND mask & prefix::INT = 0) AS BIGINT) AS removed,
    CAST(SUM(n) FILTER (WHERE mask & bit > 0 AND mask & prefix::INT > 0) AS BIGINT) AS redundant, CAST(SUM(n) FILTER (WHERE mask = bit) AS BIGINT) AS unique_fails,
    CAST(SUM(good) FILTER (WHERE mask & bit > 0 AND mask & prefix::INT = 0) AS BIGINT) AS good_lost, CAST(SUM(toxic) FILTER (WHERE mask & bit > 0 AND mask & prefix::INT = 0) AS BIGINT) AS toxic_lost FROM m, o GROUP BY part, filter_order, step, bit)
  SELECT part, filter_order, step, COALESCE(kept, 0) AS kept, COALESCE(removed, 0) AS removed, COALESCE(redundant, 0) AS redundant, COALESCE(unique_fails, 0) AS unique_fails, COALESCE(good_lost, 0) AS good_lost, COALESCE(toxic_lost, 0) AS toxic_lost,
    CAST(SUM(COALESCE(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
