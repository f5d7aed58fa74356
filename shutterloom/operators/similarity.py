"""Look-alike groups (J6, G3 to G5): exact cosine links inside blocks, then connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BLOCKED_SCENES
from ..functions.scalars import cosine
from ..storage import written
from .bursts import time_segments

#: Rows of a block: a matrix product is of two blocks at most, so is the list of open photos of a round.
BLOCK = 1024
#: Rows of a tile at least and at most; two tiles meet in a task. A tile holds more rows in larger segments, so that it is copied less often.
LEAST_TILE, MOST_TILE = 1024, 16_384
#: Tiles of links that are all wanted are no larger, as two of them may give the square of their rows.
MOST_LISTED_TILE = 2048
#: Pivots at most; they travel with the function that measures angles to them.
MOST_PIVOTS = 512
PAIR = ("segment", "cell", "tile", "other_cell", "other_tile")
#: Cosines and angles are trusted to this much; vectors whose length differs from 1 by more than NOT_UNIT bound nothing.
SLACK, NOT_UNIT = 1e-3, 4e-4


def similarity_links(rows: DataFrame, threshold: float, tile: int | None = None) -> DataFrame:
    """(a, b, cosine) of all pairs of one segment with a < b and a cosine of at least the threshold.

    rows (id, embedding, segment), embeddings of unit length; null ones link to nothing. Segments are cut
    into tiles of bounded size, and each pair of tiles that may hold a link is a group of its own, so a large
    segment becomes many tasks, and no group of rows is collected whole. Pairs are what is asked for, so n photos all alike
    give n (n - 1) / 2 rows; component_links() has what grouping needs of them. tile: rows of a tile, by default as many as suit the segment.
    """
    return _compared(rows, threshold, False, tile)


def component_links(rows: DataFrame, threshold: float, tile: int | None = None) -> DataFrame:
    """As similarity_links(), but of the links within each pair of tiles only as many as hold its components together: fewer than its rows."""
    return _compared(rows, threshold, True, tile)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links a[i]-b[i] to keep, so that they hold the same components together and none is idle.

    All components hook at once: each by one link to the lowest label beside it, if that is lower than its own, until
    no link joins two labels.
    """
    ends, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    label, keep = np.arange(len(ends)), np.zeros(len(a), bool)
    while True:
        left, right = label[x], label[y]
        open_ = np.flatnonzero(left != right)
        if not len(open_):
            return keep
        low, high = np.minimum(left, right)[open_], np.maximum(left, right)[open_]
        order = np.lexsort((low, high))
        first = order[np.r_[True, np.diff(high[order]) > 0]]
        keep[open_[first]] = True
        hook = np.arange(len(ends))
        hook[high[first]] = low[first]
        while (hook[hook] != hook).any():
            hook = hook[hook]
        label = hook[label]


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles of rows to pivots; of rows that aren't of unit length NaN."""
    size = np.linalg.norm(x, axis=1)
    unit = x / np.where(size > 0, size, 1)[:, None]
    angles = np.arccos(np.clip(unit @ pivots.T, -1, 1))
    angles[np.abs(size - 1) > NOT_UNIT] = np.nan
    return angles


def _tile_rows(n: Column, tile: int | None, most: int) -> Column:
    """Rows of a tile of a segment of n: 16 times the root, within bounds."""
    return F.lit(tile) if tile else F.least(F.lit(most), F.greatest(F.lit(LEAST_TILE), F.ceil(16 * F.sqrt(n)))).cast("int")


def tiled(rows: DataFrame, threshold: float, most: int = MOST_TILE, tile: int | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The rows of segments of one tile; the others with `cell` and `tile`; the pairs (segment, cell, tile, other_cell, other_tile) of their tiles that may hold a link.

    A segment of more than one tile is parted into cells by the nearest of some pivots, which are rows of the lowest hash, and
    cells into tiles. Each cell has the range of its rows' angles to each pivot. By the triangle inequality on the sphere two rows are at
    least as far apart as their angles to any pivot differ, so two cells whose ranges lie further apart at some pivot than the
    threshold's angle hold no link, and none of their tiles meet. The last two are None if no segment is that large.
    """
    plain = rows.where("embedding is not null").select("id", "embedding", "segment")
    n = F.count("*")
    sizes = written(plain.groupBy("segment").agg(F.ceil(n / _tile_rows(n, tile, most)).cast("int").alias("tiles"), _tile_rows(n, tile, most).alias("tile_rows")))
    many = sizes.agg(F.max("tiles")).first()[0] or 0
    if many < 2:
        return plain, None, None
    large = sizes.where("tiles > 1")
    inside = plain.join(large.select("segment", "tiles"), "segment")
    chosen = inside.orderBy(F.xxhash64("id", F.lit(29)), "id").limit(min(MOST_PIVOTS, max(2, many // 2))).select("embedding").collect()
    pivots = np.array([r[0] for r in chosen], np.float64)
    pivots = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angles, tiles = _angles(_vectors(batch.column("embedding")), pivots), batch.column("tiles").to_numpy()
            # A segment uses as many pivots as half its tiles; rows that aren't of unit length go to the first cell.
            angles[np.arange(len(pivots)) >= np.maximum(1, tiles // 2)[:, None]] = np.inf
            cell = np.where(np.isnan(angles).any(axis=1), 0, np.argmin(np.nan_to_num(angles, nan=np.inf), axis=1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "embedding", "segment")), pa.array(cell, pa.int32())], ["id", "embedding", "segment", "cell"])

    near = written(inside.mapInArrow(nearest, T.StructType([*plain.schema.fields, T.StructField("cell", T.IntegerType())])))
    held = near.groupBy("segment", "cell").agg(F.count("*").alias("rows")).join(large.select("segment", "tile_rows"), "segment")
    cells = written(held.select("segment", "cell", F.ceil(F.col("rows") / F.col("tile_rows")).cast("int").alias("tiles")))
    dealt = near.join(cells, ["segment", "cell"]).withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int")).drop("tiles")
    side = lambda c, t: cells.select("segment", F.col("cell").alias(c), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias(t))
    pairs = _near_cells(near, pivots, threshold).join(side("cell", "tile"), ["segment", "cell"]).join(side("other_cell", "other_tile"), ["segment", "other_cell"])
    small = plain.join(sizes.where("tiles = 1").select("segment"), "segment").select("id", "embedding", "segment")
    return small, dealt, pairs.where("cell < other_cell or tile <= other_tile").select(*PAIR)


def _near_cells(near: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    """(segment, cell, other_cell) of the cells, each with itself and those after it, whose ranges of angles are nowhere too far apart."""
    reach = float(np.arccos(np.clip(threshold - SLACK, -1, 1))) + SLACK
    segment = near.schema["segment"]
    cell = [segment, T.StructField("cell", T.IntegerType())]
    bounds = T.StructType([*cell, *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("low", "high"))])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angles = _angles(_vectors(batch.column("embedding")), pivots)
            unknown = np.isnan(angles)
            codes = batch.column("segment").dictionary_encode()
            key = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(pivots) + batch.column("cell").to_numpy()
            order = np.argsort(key, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0])
            first = pa.array(order[at])
            low = np.minimum.reduceat(np.where(unknown, 0, angles)[order], at, axis=0)
            high = np.maximum.reduceat(np.where(unknown, np.pi, angles)[order], at, axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("segment").take(first), batch.column("cell").take(first), pa.array(list(low), pa.list_(pa.float64())), pa.array(list(high), pa.list_(pa.float64()))], ["segment", "cell", "low", "high"])

    def whole(rows: pa.Table) -> pa.Table:
        low, high = _vectors(rows["low"]).min(axis=0), _vectors(rows["high"]).max(axis=0)
        return rows.slice(0, 1).select(["segment", "cell"]).append_column("low", pa.array([low], pa.list_(pa.float64()))).append_column("high", pa.array([high], pa.list_(pa.float64())))

    def pair(rows: pa.Table) -> pa.Table:
        cells, low, high = rows["cell"].to_numpy(), _vectors(rows["low"]), _vectors(rows["high"])
        order = np.argsort(cells)
        cells, low, high = cells[order], low[order], high[order]
        apart = np.zeros((len(cells), len(cells)))
        for k in range(low.shape[1]):
            apart = np.maximum(apart, low[:, k][:, None] - high[:, k][None, :])
        i, j = np.nonzero(np.triu(np.maximum(apart, apart.T) <= reach))
        return pa.table([rows["segment"].take(pa.array(np.zeros(len(i), np.int64))), pa.array(cells[i], pa.int32()), pa.array(cells[j], pa.int32())], names=["segment", "cell", "other_cell"])

    # A row for each batch, segment and cell, then one for each segment and cell: MOST_PIVOTS of them meet in a group.
    table = near.mapInArrow(ranges, bounds).groupBy("segment", "cell").applyInArrow(whole, bounds)
    return written(table.groupBy("segment").applyInArrow(pair, T.StructType([*cell, T.StructField("other_cell", T.IntegerType())])))


def _links(ids: np.ndarray, x: np.ndarray, others: np.ndarray | None, y: np.ndarray | None, threshold: float, thin: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends and cosines of the links among the rows, or between them and others, by blocks."""
    same, found = others is None, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if same:
        others, y = ids, x
    for i in range(0, len(ids), BLOCK):
        for j in range(i if same else 0, len(others), BLOCK):
            scores = x[i : i + BLOCK] @ y[j : j + BLOCK].T
            p, q = np.nonzero(scores >= threshold)
            if same and i == j:
                p, q = p[p < q], q[p < q]
            a, b, close = ids[i + p], others[j + q], scores[p, q]
            if thin:
                stays = forest(a, b)
                a, b, close = a[stays], b[stays], close[stays]
            found.append((a, b, close))
    a, b, close = (np.concatenate(c) for c in zip(*found, strict=True))
    if thin and len(found) > 2:
        stays = forest(a, b)
        a, b, close = a[stays], b[stays], close[stays]
    return np.minimum(a, b), np.maximum(a, b), close


def _compared(rows: DataFrame, threshold: float, thin: bool, tile: int | None) -> DataFrame:
    """Segments of one tile are a row each; of larger ones each row is sent once to every pair of tiles that its own is part of."""
    small, dealt, pairs = tiled(rows, threshold, MOST_TILE if thin else MOST_LISTED_TILE, tile)
    schema, names = "a bigint, b bigint, cosine double", ["a", "b", "cosine"]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column("rows"):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _links(*_unpack(held.values), None, None, threshold, thin)], names)

    def between(rows: pa.Table) -> pa.Table:
        pair, right = rows["pair"][0].as_py(), rows["right"].to_numpy()
        ids, x = rows["id"].to_numpy(), _vectors(rows["embedding"])
        if (pair["cell"], pair["tile"]) == (pair["other_cell"], pair["other_tile"]):
            return pa.table(list(map(pa.array, _links(ids, x, None, None, threshold, thin))), names=names)
        return pa.table(list(map(pa.array, _links(ids[~right], x[~right], ids[right], x[right], threshold, thin))), names=names)

    found = small.groupBy("segment").agg(F.collect_list(F.struct("id", "embedding")).alias("rows")).select("rows").mapInArrow(within, schema)
    if pairs is None:
        return found
    own = F.struct(F.col("cell").alias("c"), F.col("tile").alias("t"), F.lit(False).alias("right"))
    other = F.struct(F.col("other_cell").alias("c"), F.col("other_tile").alias("t"), F.lit(True).alias("right"))
    sides = F.when((F.col("cell") == F.col("other_cell")) & (F.col("tile") == F.col("other_tile")), F.array(own)).otherwise(F.array(own, other))
    parts = pairs.select(F.struct(*PAIR).alias("pair"), F.explode(sides).alias("s")).select("pair", "pair.segment", F.col("s.c").alias("cell"), F.col("s.t").alias("tile"), "s.right")
    sent = dealt.join(parts, ["segment", "cell", "tile"]).select("pair", "right", "id", "embedding")
    return found.unionByName(sent.groupBy("pair").applyInArrow(between, schema))


def _unpack(x: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    return x.field("id").to_numpy(), _vectors(x.field("embedding"))


def union_gate(a: str, b: str) -> Column:
    """G4 on columns `{a}face`, `{a}scene`, `{a}hist` and those of b: whether two look-alikes may join.

    Two faces decide by their cosine alone. Else a blocked pair of scenes denies, then two histograms
    decide by theirs, and what is unknown allows.
    """
    faces = [F.col(f"{x}face") for x in (a, b)]
    scenes = [F.col(f"{x}scene") for x in (a, b)]
    hists = [F.col(f"{x}hist") for x in (a, b)]
    pair = F.concat_ws("|", F.least(*scenes), F.greatest(*scenes))
    blocked = scenes[0].isNotNull() & scenes[1].isNotNull() & pair.isin(*("|".join(p) for p in BLOCKED_SCENES))
    return (
        F.when(faces[0].isNotNull() & faces[1].isNotNull(), cosine(*faces) >= 0.50)
        .when(blocked, False)
        .when(hists[0].isNotNull() & hists[1].isNotNull(), cosine(*hists) >= 0.90)
        .otherwise(True)
    )


def gated(links: DataFrame, meta: DataFrame) -> DataFrame:
    """links that the gate allows; meta (id, face, scene, hist)."""
    side = lambda x: meta.select(F.col("id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("face", "scene", "hist")))
    met = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return met.where(union_gate("a_", "b_")).select(*links.columns)


def connected(links: DataFrame) -> DataFrame:
    """(id, group_id): every end of a link with the smallest id of its component.

    Labels hook to the smallest that any neighbour of their members has, then follow their own label;
    rounds are written tables and end when none moves.
    """
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    edges = written(links.select(both.alias("e")).select("e.x", "e.y").distinct())
    labels = written(edges.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("y")).select("id", F.least("id", "y").alias("group_id")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("y"), F.col("group_id").alias("low")), "y").groupBy(F.col("x").alias("id")).agg(F.min("low").alias("low"))
        hooks = near.join(labels, "id").groupBy("group_id").agg(F.min("low").alias("low"))
        hooks = written(hooks.select("group_id", F.least("group_id", "low").alias("to")))
        if hooks.where("to < group_id").isEmpty():
            return labels
        far = hooks.select(F.col("group_id").alias("to"), F.col("to").alias("far"))
        moved = hooks.join(far, "to", "left").select("group_id", F.least("to", F.coalesce("far", "to")).alias("new"))
        labels = written(labels.join(moved, "group_id").select("id", F.col("new").alias("group_id")))


def group_by_similarity(photos: DataFrame, threshold: float = 0.90, gap: float | None = 60.0, meta: DataFrame | None = None) -> DataFrame:
    """(group_id, id) of groups of two photos or more.

    photos (id, embedding, shot_at, and manual_group_id if there is any). Photos with an anchor group by it
    alone, an empty one being none; the others by links within their time segment (gap None: one segment
    of all), gated where meta is given. group_id is the smallest id of the group.
    """
    anchor = F.nullif(F.col("manual_group_id"), F.lit("")) if "manual_group_id" in photos.columns else F.lit(None).cast("string")
    rows = photos.withColumn("__anchor", anchor)
    anchored = rows.where("__anchor is not null")
    named = anchored.groupBy("__anchor").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    manual = anchored.join(named, "__anchor").select("group_id", "id")
    free = rows.where("__anchor is null").select("id", "embedding", "shot_at")
    cut = free.withColumn("segment", F.lit(0).cast("long")) if gap is None else time_segments(free, gap)
    # The gate judges every pair, so it needs them all: at most a block pair's square for each pair of blocks.
    links = component_links(cut, threshold) if meta is None else gated(similarity_links(cut, threshold), meta)
    return manual.unionByName(connected(links).select("group_id", "id"))


def face_groups(photos: DataFrame, threshold: float = 0.50, gap: float | None = None) -> DataFrame:
    """People among analysed photos with a face, by face embedding, over all times unless a gap is given."""
    faces = photos.where("analysis_status = 'done' and face_detected = 1")
    return group_by_similarity(faces.select("id", F.col("face_embedding").alias("embedding"), "shot_at"), threshold, gap)


def collapse_near_duplicates(members: DataFrame, threshold: float = 0.97) -> DataFrame:
    """(group_id, id, leader_id): in order of `pos`, the first unclaimed photo leads all later unclaimed ones that are as similar.

    members (group_id, id, pos, embedding). Photos without an embedding lead themselves. Every round settles the
    first BLOCK open photos of each group and takes out the later ones that these lead, a block a row, so a group
    of any size is led in bounded tasks; groups as the prefilter leaves them need one round.
    """

    def lead(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__place")
        ids = rows["id"].to_numpy()
        leader, free = ids.copy(), np.ones(len(ids), bool)
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        scores = x @ x.T
        for n in range(len(ids)):
            if free[n]:
                taken = free & (scores[n] >= threshold)
                taken[: n + 1] = False
                leader[taken] = ids[n]
                free[taken] = False
        return pd.DataFrame({"group_id": rows["group_id"].to_numpy(), "id": ids, "leader_id": leader})

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, group in enumerate(batch.column("group_id").to_pylist()):
                leaders, x = _unpack(batch.column("leaders")[n].values)
                ids, y = _unpack(batch.column("rows")[n].values)
                near = y @ x.T >= threshold
                held = near.any(axis=1)
                first = leaders[near.argmax(axis=1)[held]]
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(first), pa.int64()), pa.array(ids[held]), pa.array(first)], ["group_id", "id", "leader_id"])

    schema, order = "group_id bigint, id bigint, leader_id bigint", Window.partitionBy("group_id").orderBy("pos", "id")
    rows = members.select("group_id", "id", "pos", "embedding")
    found = rows.where("embedding is null").select("group_id", "id", F.col("id").alias("leader_id"))
    # Numbered once: a round takes the first blocks of places whose open photos are BLOCK together at most, one block at least.
    placed = rows.where("embedding is not null").withColumn("__place", F.row_number().over(order) - 1)
    rest = written(placed.withColumn("__block", F.floor(F.col("__place") / BLOCK)))
    while True:
        upto = F.sum("count").over(Window.partitionBy("group_id").orderBy("__block"))
        sizes = rest.groupBy("group_id", "__block").count().withColumn("__now", upto <= BLOCK)
        sized = written(rest.join(sizes.drop("count"), ["group_id", "__block"]))
        now, later = sized.where("__now"), sized.where("not __now")
        if later.isEmpty():
            return found.unionByName(now.groupBy("group_id").applyInPandas(lead, schema))
        led = written(now.groupBy("group_id").applyInPandas(lead, schema))
        heads = now.join(led.where("id = leader_id").select("group_id", "id"), ["group_id", "id"]).groupBy("group_id")
        heads = heads.agg(F.sort_array(F.collect_list(F.struct("__place", "id", "embedding"))).alias("leaders"))
        blocks = later.groupBy("group_id", "__block").agg(F.collect_list(F.struct("id", "embedding")).alias("rows"))
        claimed = written(blocks.select("group_id", "rows").join(heads, "group_id").mapInArrow(claim, schema))
        found = found.unionByName(led).unionByName(claimed)
        rest = later.drop("__now").join(claimed, ["group_id", "id"], "left_anti")
