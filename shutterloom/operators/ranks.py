"""Exact order statistics without a list of all values in one place."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Bits that one scan of refined_places() narrows a key by: 2048 counts for each open range.
DIGIT = 11

def values_at(rows: DataFrame, value: str, places: dict[str, Callable[[Column], Column]], keys: Sequence[str] = ()) -> DataFrame:
    """One row for each key: (keys, total, a column for each of places): the value at that place, from 0 on, in ascending order.

    A place is a function of the total. Null values don't count; a key without values has no row. Equal values are counted
    within tasks first; the distinct ones are dealt by range, each range sums its own, and one row a range says what lies before it.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    dealt = written(counts.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()))
    whole = Window.partitionBy(*keys)
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*keys, "__part").agg(F.sum("__n").alias("__own"))
    parts = parts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__p"), F.sum("__own").over(whole).alias("total"), F.coalesce(F.sum("__own").over(ahead), F.lit(0)).alias("__before"))
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy("__v"))
    met = F.col("__part") == F.col("__p")
    for k in keys:
        met &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    placed = dealt.withColumn("__upto", upto).join(parts, met).withColumn("__upto", F.col("__upto") + F.col("__before"))
    here = lambda at: (F.col("__upto") > at) & (F.col("__upto") - F.col("__n") <= at)
    return placed.groupBy(*keys).agg(F.first("total").alias("total"), *(F.max(F.when(here(at(F.col("total"))), F.col("__v"))).alias(name) for name, at in places.items()))


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, total, a column for each of shares): the quantile, linear between the two values about it."""
    places = {}
    for name, share in shares.items():
        places[f"__{name}_low"] = lambda n, p=share: F.floor((n - 1) * p)
        places[f"__{name}_high"] = lambda n, p=share: F.ceil((n - 1) * p)
    found = values_at(rows, value, places, keys)

    def between(name: str, share: float) -> Column:
        low, high, at = F.col(f"__{name}_low").cast("double"), F.col(f"__{name}_high").cast("double"), (F.col("total") - 1) * share
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*keys, "total", *(between(name, share).alias(name) for name, share in shares.items()))


def upper_median(n: Column) -> Column:
    """The place of the upper one of the two middle values."""
    return F.floor(n / 2)



def numbered(rows: DataFrame, order: Sequence[Column], to: str = "place") -> DataFrame:
    """rows with `to`, the place of each from 0 on in the given order, which should leave no ties that differ.

    The rows are dealt by range, written, and numbered within their range; what lies before a range is a sum of
    counts, one for each partition. No task sorts more than its range.
    """
    part, own = f"__{to}_part", f"__{to}_own"
    dealt = written(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    before, total = {}, 0
    for at, n in sorted(dealt.groupBy(part).count().collect()):
        before[at], total = total, total + n
    ahead = F.element_at(F.array(*(F.lit(before.get(at, 0)).cast("long") for at in range(max(before, default=0) + 1))), F.col(part) + 1)
    placed = dealt.withColumn(own, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    return placed.withColumn(to, ahead + F.col(own)).drop(part, own)


def _keys(values: np.ndarray, width: int) -> np.ndarray:
    """Unsigned numbers in the order of the values, floats of 32 or 64 bits; both zeros are one."""
    values = values + values.dtype.type(0)
    bits = values.view(np.int32 if width == 32 else np.int64).astype(np.int64)
    top = np.int64(-(1 << 63)) if width == 64 else np.int64(1 << 31)
    # Of negative numbers a larger pattern is the smaller value.
    turned = np.where(bits < 0, bits ^ np.int64((1 << (width - 1)) - 1), bits)
    return (turned ^ top if width == 64 else turned + top).view(np.uint64)


def _value(key: int, width: int) -> float:
    bits = key - (1 << (width - 1))
    if bits < 0:
        bits ^= (1 << (width - 1)) - 1
    return float(np.array(bits, np.int32 if width == 32 else np.int64).view(np.float32 if width == 32 else np.float64))


def refined_places(rows: DataFrame, columns: Sequence[str], places: Callable[[int], Sequence[int]], by: str | None = None, groups: Sequence[str | None] = (None,)) -> dict:
    """{(column, group): (total, values at the places)} of several columns at once, no value moved.

    columns are all float or all double; by is a column of few known groups (none: one group of all rows). places gives the
    places asked for, from 0 on in ascending order, out of the total; nulls and NaN don't count. Values are taken as whole numbers of the
    same order. Each scan counts, for every range that is still open, how many values have which next digit, in tasks; the driver sums
    2048 counts a range and narrows every place to the digit it lies in. Three scans settle floats, six doubles, whatever the values and
    however often one is repeated. rows are read once a scan, so they should be a table.
    """
    width = 32 if dict(rows.dtypes)[columns[0]] == "float" else 64
    names = list(columns) + ([by] if by else [])
    # Of each open range, named by what is known of its keys from the top: the places in it, and where they lie within.
    totals, wanted, known = {}, {(c, g, 0): [] for c in columns for g in groups}, 0
    while known < width and wanted:
        step = min(DIGIT, width - known)
        left = width - known - step
        listed, size = list(wanted), 1 << step

        def count(batches: Iterator[pa.RecordBatch], listed=listed, known=known, left=left, size=size) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(listed), size), np.int64)
            for batch in batches:
                kind = np.array(batch.column(by).to_pylist(), object) if by else None
                held: dict = {}
                for n, (c, g, prefix) in enumerate(listed):
                    if (c, g) not in held:
                        values = batch.column(c).to_numpy(zero_copy_only=False)
                        values = values[~np.isnan(values) & (True if kind is None else kind == g)]
                        held[c, g] = _keys(values, width)
                    keys = held[c, g]
                    if known:
                        keys = keys[keys >> np.uint64(width - known) == np.uint64(prefix)]
                    sums[n] += np.bincount((keys >> np.uint64(left) & np.uint64(size - 1)).astype(np.int64), minlength=size)
            at, digit = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(digit, pa.int32()), pa.array(sums[at, digit], pa.int64())], ["range", "digit", "n"])

        found = np.zeros((len(listed), size), np.int64)
        for at, digit, n in rows.select(*names).mapInArrow(count, "range int, digit int, n bigint").groupBy("range", "digit").agg(F.sum("n")).collect():
            found[at, digit] = n
        upto = np.cumsum(found, axis=1)
        fresh: dict = {}
        for at, (c, g, prefix) in enumerate(listed):
            if not known:
                totals[c, g] = int(upto[at, -1])
                wanted[c, g, 0] = [(k, k) for k in dict.fromkeys(places(totals[c, g]))] if totals[c, g] else []
            for place, rest in wanted.pop((c, g, prefix)):
                digit = int(np.searchsorted(upto[at], rest, side="right"))
                fresh.setdefault((c, g, (prefix << step) | digit), []).append((place, rest - (int(upto[at, digit - 1]) if digit else 0)))
        wanted, known = fresh, known + step
    values = {(c, g, place): _value(key, width) for (c, g, key), held in wanted.items() for place, _ in held}
    return {(c, g): (n, [values[c, g, k] for k in places(n)] if n else []) for (c, g), n in totals.items()}


def refined_medians(rows: DataFrame, columns: Sequence[str], by: str | None = None, groups: Sequence[str | None] = (None,)) -> dict:
    """{(column, group): (total, median or None)}, the median halfway between the two middle values."""
    found = refined_places(rows, columns, lambda n: (math.floor((n - 1) / 2), math.ceil((n - 1) / 2)), by, groups)
    return {at: (n, (v[0] + v[1]) / 2 if v else None) for at, (n, v) in found.items()}
