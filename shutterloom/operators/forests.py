"""Boosted trees of depth three, of many models at once (M8, M9).

All models see one table of binned features. A level of the trees of all models is one scan: each task gives its sums of
weights and residuals by model, node, feature and bin; the driver adds these up and picks the splits. Which
rows a model leaves out, for good or for one tree, follows from a hash of the row's key, so nothing is copied or sampled.

A row of the table is a block of samples, each of its columns one binary value, as the table is read for every level. Features of
few bins are counted together, one cell for each combination, and what is asked of one feature is summed from these cells at a task's end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, settings, spread, written

DEPTH, BINS = 3, 32
#: Trees after which the scores so far are written beside the rows, so that no row meets more trees than these a level.
WRITE_EVERY = 2
#: A cut that no bin is above: all rows go left.
NO_CUT = 255
#: Samples of a block, and blocks that a task takes at once.
BLOCK, AT_ONCE = 4096, 4
#: Combinations of bins that are counted together at most.
CELLS = 4096
#: A split has to be better than an earlier one by this share, as sums of equal numbers differ in their last digits.
TIE = 1e-9
_COLUMNS = ("label", "weight", "key", "bins", "scores")
_TABLE = ", ".join(f"{c} binary" for c in _COLUMNS)


def mixed(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to 1 by key and salt, as even as random ones."""
    x = key.astype(np.uint64) + np.uint64(salt % (1 << 64))
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _below(key: np.ndarray, salts: list[int], share: float) -> np.ndarray:
    """[row, salt]: mixed(key, salt) < share, some thousand rows at a time so that they stay near."""
    out, top = np.empty((len(salts), len(key)), bool), np.uint64(math.ceil(share * (1 << 53)))
    for start in range(0, len(key), BLOCK):
        own = key[start : start + BLOCK].astype(np.uint64)
        x, y = np.empty_like(own), np.empty_like(own)
        for n, salt in enumerate(salts):
            np.add(own, np.uint64(salt % (1 << 64)), out=x)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
                np.right_shift(x, np.uint64(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                if factor:
                    np.multiply(x, np.uint64(factor), out=x)
            np.less(np.right_shift(x, np.uint64(11), out=x), top, out=out[n, start : start + BLOCK])
    return out.T


@dataclass(frozen=True)
class Plan:
    """How the models differ. salts: one a model. out: the share of rows that a model never sees; share: what a tree sees of the others."""

    salts: tuple[int, ...]
    trees: int
    rate: float
    out: float = 0.0
    share: float = 1.0

    def left_out(self, key: np.ndarray) -> np.ndarray:
        """[row, model]: whether the model never sees the row."""
        if self.out <= 0:
            return np.zeros((len(key), len(self.salts)), bool)
        return _below(key, [salt * 0x9E3779B97F4A7C15 for salt in self.salts], self.out)

    def seen(self, key: np.ndarray, tree: int) -> np.ndarray:
        """[row, model]: whether the model's tree sees the row."""
        if self.share >= 1:
            return ~self.left_out(key)
        drawn = _below(key, [(salt * 1_000_003 + tree + 1) * 0xD1B54A32D192ED03 for salt in self.salts], self.share)
        return drawn if self.out <= 0 else drawn & ~self.left_out(key)


@dataclass
class Forests:
    """Models over named features: cuts between bins, values for what is missing, and for each tree and model its splits and leaves."""

    features: tuple[str, ...]
    cuts: list[np.ndarray]
    fills: np.ndarray
    base: np.ndarray
    splits: list[np.ndarray] = field(default_factory=list)
    bounds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """[row, feature]: how many cuts lie below the value."""
        filled = np.where(np.isnan(values), self.fills, values)
        return np.stack([np.searchsorted(c, filled[:, n], side="left") for n, c in enumerate(self.cuts)], 1).astype(np.uint8)

    def scores(self, bins: np.ndarray, start: int = 0) -> np.ndarray:
        """[row, model]: the sum of the trees from `start` on, with the base if that is 0."""
        base = self.base if start == 0 else np.zeros_like(self.base)
        return self.added(np.tile(base, (len(bins), 1)).T.copy(), np.ascontiguousarray(bins.T), start).T

    def added(self, out: np.ndarray, columns: np.ndarray, start: int = 0) -> np.ndarray:
        """out, [model, row], with the trees from `start` on added; columns: the bins, [feature, row]."""
        for split, bound, leaf in zip(self.splits[start:], self.bounds[start:], self.leaves[start:], strict=True):
            for m in range(len(self.base)):
                out[m] += leaf[m].take(places(columns, split[m], bound[m], DEPTH))
        return out

    def predictions(self, columns: list[Column]) -> Column:
        """An array of one raw score for each model; columns are the features in order, NaN or null where missing."""

        def predict(*values: pd.Series) -> pd.Series:
            found = self.scores(self.bins(np.stack([v.to_numpy(np.float64, na_value=np.nan) for v in values], 1)))
            return pd.Series(list(found), dtype=object)

        return F.pandas_udf(predict, "array<double>")(*columns)


def places(columns: np.ndarray, split: np.ndarray, bound: np.ndarray, depth: int) -> np.ndarray:
    """The node of its level, from 0 on, that each row of columns [feature, row] reaches in `depth` steps.

    Every node's comparison is made of whole columns, and a row takes the ones on its way.
    """
    # Bounds of the bins' own type, as others would have the bins widened.
    at, bound = np.zeros(columns.shape[1], np.uint8), bound.astype(np.uint8)
    for level in range(depth):
        first, step = 2**level - 1, np.zeros(columns.shape[1], bool)
        for n in range(2**level):
            above = columns[split[first + n]] > bound[first + n]
            step |= above & (at == n) if level else above
        at = 2 * at + step
    return at


def _packed(label: np.ndarray, weight: np.ndarray, key: np.ndarray, columns: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """Rows of the table of samples; columns: [feature, row], scores: [model, row]."""
    starts = range(0, len(label), BLOCK)
    parts = ((label, np.float64), (weight, np.float64), (key, np.int64), (columns, np.uint8), (scores, np.float32))
    return pa.RecordBatch.from_arrays([pa.array([x[..., n : n + BLOCK].astype(kind).tobytes() for n in starts], pa.binary()) for x, kind in parts], list(_COLUMNS))


def _unpacked(batch: pa.RecordBatch, width: int, models: int) -> tuple[np.ndarray, ...]:
    """What _packed() took, of all blocks of the batch."""
    shapes = ((np.float64, ()), (np.float64, ()), (np.int64, ()), (np.uint8, (width,)), (np.float32, (models,)))
    return tuple(np.concatenate([np.empty((*shape, 0), kind), *(np.frombuffer(x.as_buffer(), kind).reshape(*shape, -1) for x in batch.column(c))], -1) for c, (kind, shape) in zip(_COLUMNS, shapes, strict=True))


def train(rows: DataFrame, features: tuple[str, ...], plan: Plan) -> Forests:
    """Models on rows (the features, label, weight, key): least squares, each tree fitted to what its model has left.

    A missing value is the feature's mean; a feature that no row has is 0 in all. Cuts are quantiles, BINS - 1 at most. The driver gets, for each
    level, two sums for every task, model, node, feature and bin: some megabytes for 20 models from each of as many tasks as there are cores, whatever the rows.
    """
    nan = [F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f) for f in features]
    # Each level reads all rows, so they are spread over all cores.
    known = written(spread(rows.select("label", F.col("weight").cast("double").alias("weight"), F.col("key").cast("long").alias("key"), *nan), "key"))
    means = known.agg(*(F.avg(f) for f in features)).first()
    at = [k / BINS for k in range(1, BINS)]
    cuts = [np.unique(q) for q in known.approxQuantile(list(features), at, 0.001)]
    models = len(plan.salts)
    found = Forests(tuple(features), cuts, np.array([0.0 if m is None else m for m in means]), np.zeros(models))
    width, spark = len(features), rows.sparkSession

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in features], 1)
            columns = np.ascontiguousarray(found.bins(values).T)
            yield _packed(*(batch.column(c).to_numpy(zero_copy_only=False) for c in _COLUMNS[:3]), columns, np.zeros((models, len(values)), np.float32))

    arrow = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with settings(spark, {arrow: str(2 * BLOCK)}):
        table = written(known.withColumn("label", F.col("label").cast("double")).mapInArrow(binned, _TABLE))
    # Blocks are long, so few are read at once; a task reads a file, and as many give sums as there are cores.
    with settings(spark, {arrow: str(AT_ONCE), "spark.sql.parquet.columnarReaderBatchSize": str(AT_ONCE), "spark.sql.files.maxPartitionBytes": str(1 << 50)}):
        found.base = _base(table, plan, width)
        done = 0
        for tree in range(plan.trees):
            if tree - done == WRITE_EVERY:
                before, table, done = table, written(table.mapInArrow(_scored(found, done, width), _TABLE)), tree
                dropped(before)
            split, bound = np.zeros((models, 2**DEPTH - 1), np.int64), np.full((models, 2**DEPTH - 1), NO_CUT, np.int64)
            for level in range(DEPTH):
                sums = _sums(table, found, plan, tree, done, (split, bound), level)
                first = 2**level - 1
                best, cut, sides = _best(sums)
                split[:, first : 2 * first + 1], bound[:, first : 2 * first + 1] = best, cut
            found.splits.append(split)
            found.bounds.append(bound)
            found.leaves.append(plan.rate * sides.reshape(models, -1))
        dropped(table)
    return found


def _total(table: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], *shape: int) -> np.ndarray:
    """The sum of what count makes of each task's batches, arrays of doubles of this shape, in the tasks' order."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([count(batches).tobytes()], pa.binary())], ["sums"])

    total = np.zeros(shape)
    for found in table.mapInArrow(one, "sums binary").toArrow()["sums"]:
        total += np.frombuffer(found.as_buffer(), np.float64).reshape(shape)
    return total


def _base(table: DataFrame, plan: Plan, width: int) -> np.ndarray:
    """The weighted mean label of the rows that each model sees."""
    models = len(plan.salts)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2, models))
        for batch in batches:
            label, weight, key, _, _ = _unpacked(batch, width, models)
            w = weight[:, None] * ~plan.left_out(key)
            total += w.sum(axis=0), (w * label[:, None]).sum(axis=0)
        return total

    w, wy = _total(table, count, 2, models)
    return np.divide(wy, w, out=np.zeros(models), where=w != 0)


def _scored(found: Forests, done: int, width: int):
    """Adds what the trees from `done` on give to the scores; the base isn't in them."""
    models = len(found.base)
    known = Forests(found.features, found.cuts, found.fills, np.zeros_like(found.base), found.splits[done:], found.bounds[done:], found.leaves[done:])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, columns, scores = _unpacked(batch, width, models)
            yield _packed(*rest, columns, known.added(scores.astype(np.float64), columns))

    return add


def _together(sizes: list[int]) -> list[list[int]]:
    """Features in groups whose bins make CELLS combinations at most, large ones first; those of one bin are in none, but there is a group."""
    groups: list[list[int]] = []
    for n in sorted((n for n, size in enumerate(sizes) if size > 1), key=lambda n: -sizes[n]):
        own = next((g for g in groups if math.prod(sizes[k] for k in g) * sizes[n] <= CELLS), None)
        if own is None:
            groups.append(own := [])
        own.append(n)
    return groups or [[0]]


def _sums(table: DataFrame, found: Forests, plan: Plan, tree: int, done: int, tops: tuple, level: int) -> np.ndarray:
    """[model, node of the level, feature, bin, (weight, weight x residual)]; features of one bin have all in it."""
    known = Forests(found.features, found.cuts, found.fills, found.base, found.splits[done:], found.bounds[done:], found.leaves[done:])
    split, bound = tops
    models, nodes, sizes = len(found.base), 2**level, [len(c) + 1 for c in found.cuts]
    width, groups = len(sizes), _together(sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        cells = [np.zeros((models, 2, nodes * math.prod(sizes[k] for k in g))) for g in groups]
        for batch in batches:
            label, weight, key, columns, scores = _unpacked(batch, width, models)
            if not len(label):
                continue
            codes = [np.ravel_multi_index([columns[k].astype(np.int64) for k in g], [sizes[k] for k in g]) for g in groups]
            left = label - known.added(scores + known.base[:, None], columns)
            seen = plan.seen(key, tree)
            for m in range(models):
                own = np.flatnonzero(seen[:, m])
                w = weight[own]
                wr = w * left[m, own]
                node = places(columns, split[m], bound[m], level)[own].astype(np.int64) if level else None
                for code, sums in zip(codes, cells, strict=True):
                    at = code[own]
                    if level:
                        at += node * (sums.shape[2] // nodes)
                    sums[m, 0] += np.bincount(at, w, sums.shape[2])
                    sums[m, 1] += np.bincount(at, wr, sums.shape[2])
        out = np.zeros((models, nodes, width, BINS, 2))
        for g, sums in zip(groups, cells, strict=True):
            whole = sums.reshape(models * 2 * nodes, -1)
            for k, own in zip(g, np.unravel_index(np.arange(whole.shape[1]), [sizes[k] for k in g]), strict=True):
                each = whole @ (own[:, None] == np.arange(sizes[k])).astype(np.float64)
                out[:, :, k, : sizes[k]] = np.moveaxis(each.reshape(models, 2, nodes, -1), 1, -1)
        for k in (k for k in range(width) if sizes[k] == 1):
            out[:, :, k, 0] = out[:, :, groups[0][0]].sum(axis=2)
        return out

    return _total(table, count, models, nodes, width, BINS, 2)


def _best(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, cut and the means on either side, [model, node], of the split that takes most of the squares away; NO_CUT where none does."""
    models, nodes, width, _, _ = sums.shape
    left = np.cumsum(sums, axis=3)
    whole = left[:, :, :, -1:, :]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - whole[..., 1] ** 2 / whole[..., 0]
    gain = np.where((left[..., 0] > 1e-9) & (right[..., 0] > 1e-9), gain, -1.0).reshape(models, nodes, -1)
    at = (gain >= gain.max(axis=2, keepdims=True) * (1 - TIE)).argmax(axis=2)
    good = np.take_along_axis(gain, at[:, :, None], 2)[:, :, 0] > 1e-12
    feature, cut = np.where(good, at // BINS, 0), np.where(good, at % BINS, NO_CUT)
    sides = np.zeros((models, nodes, 2))
    for m in range(models):
        for n in range(nodes):
            parts = (left[m, n, feature[m, n], cut[m, n]], right[m, n, feature[m, n], cut[m, n]]) if good[m, n] else (whole[m, n, 0, 0], np.zeros(2))
            sides[m, n] = [p[1] / p[0] if p[0] > 1e-9 else 0.0 for p in parts]
    return feature, cut, sides
