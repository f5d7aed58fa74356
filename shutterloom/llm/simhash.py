"""SimHash near-duplicates by tiled exact comparison.

Every text gets a fingerprint of 64-bit words. Distinct fingerprints are dealt into tiles by the
population counts of their parts, each tile cut into blocks of bounded size; a pair of tiles whose
counts differ by more than the radius can hold no link and is never formed. The remaining block
pairs are compared exactly with numpy's exclusive or and bit counts, and the links are joined
into components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stash, table, unused

SEED = 42
#: Rows of a block; a block pair compares at most the square of it. Rows of one lane are sent to few other tiles, so
#: their blocks can be smaller: a hot tile is more and shorter tasks.
BLOCK, NARROW_BLOCK = 4096, 1024
#: Shingles of a block, where sizes count: their hashes are held for two blocks at most.
WEIGHT = 1 << 21
#: Cells of a comparison that numpy holds at once.
CELLS = 1 << 20
#: Comparisons that take as long as bringing a pair of tiles together.
TILE_PAIR = 2000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of `words` words after lower-casing A-Z; fewer words make one shingle, none make none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are those set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        bits = np.unpackbits(part.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for sub in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            count += bits[sub : sub + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * count > len(hashes), bitorder="little").tobytes(), "little")


def remix(hashes: np.ndarray) -> np.ndarray:
    """A second, independent-looking 64-bit hash of each hash: a multiply-and-shift finisher."""
    h = hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_udf(shingle_words: int, lanes: int):
    """text -> (array of `lanes` fingerprint words, number of shingles)."""

    @F.arrow_udf("struct<lanes:array<bigint>,shingles:bigint>")
    def fingerprints(text: pa.Array) -> pa.Array:
        words, counts = [], []
        for t in text.to_pylist():
            h = shingle_hashes(t, shingle_words)
            counts.append(len(h))
            own = []
            for lane in range(lanes):
                own.append(_signed(majority(h)))
                if lane + 1 < lanes:
                    h = remix(h)
            words.append(own)
        return pa.StructArray.from_arrays([pa.array(words, pa.list_(pa.int64())), pa.array(counts, pa.int64())], ["lanes", "shingles"])

    return fingerprints


def set_fingerprint_udf(shingle_words: int, lanes: int):
    """text -> (array of `lanes` fingerprint words, number and digest) of its distinct shingles."""

    @F.arrow_udf("struct<lanes:array<bigint>,shingles:bigint,digest:binary>")
    def fingerprints(text: pa.Array) -> pa.Array:
        words, counts, digests = [], [], []
        for t in text.to_pylist():
            h = np.unique(shingle_hashes(t, shingle_words))
            counts.append(len(h))
            digests.append(xxhash.xxh3_128_digest(h.tobytes()))
            own = []
            for lane in range(lanes):
                own.append(_signed(majority(h)))
                if lane + 1 < lanes:
                    h = remix(h)
            words.append(own)
        return pa.StructArray.from_arrays([pa.array(words, pa.list_(pa.int64())), pa.array(counts, pa.int64()), pa.array(digests, pa.binary())], ["lanes", "shingles", "digest"])

    return fingerprints


def shingle_set_udf(shingle_words: int):
    """text -> the sorted hashes of its distinct shingles, eight bytes each."""

    @F.arrow_udf("binary")
    def sets(text: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(t, shingle_words)).tobytes() for t in text.to_pylist()], pa.binary())

    return sets


def parts_for(rows: int, radius: int, bits: int = 64) -> int:
    """Into how many parts, 1 to half the bits, a fingerprint is cut for its tile: the number with the least expected work.

    A tile key is the population count of each part; two fingerprints within the radius have keys
    within the radius in summed difference. More parts make smaller tiles with more neighbours. The work is
    counted for random bits: pairs of tiles, each worth TILE_PAIR comparisons, and comparisons, which are the square of
    the rows times the chance that two share a tile, times the neighbours. Large radii, which
    would have more neighbours than there are tiles, keep one part.
    """
    best, least, parts = 1, math.inf, 1
    while parts <= bits // 2 and (parts == 1 or radius <= 4):
        width = bits // parts
        meet = (math.comb(2 * width, width) / 4**width) ** parts
        # Points of summed size within the radius: choose the parts that differ, their signs and their sizes.
        near = sum(math.comb(parts, k) * 2**k * math.comb(radius, k) for k in range(min(parts, radius) + 1))
        work = near * (min(rows, 1 / meet) * TILE_PAIR + rows**2 * meet)
        if work < least:
            best, least = parts, work
        parts *= 2
    return best


def steps(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Key differences of summed size within the radius, each with a positive first non-zero part, and zero: every pair of tiles once."""

    def within(parts: int, left: int) -> Iterator[tuple[int, ...]]:
        if not parts:
            yield ()
            return
        for x in range(-left, left + 1):
            for rest in within(parts - 1, left - abs(x)):
                yield (x, *rest)

    return [d for d in within(parts, radius) if next((x for x in d if x), 1) > 0]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a-b, as many as hold their components together: each member to the smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]


def block_links(left: tuple, right: tuple | None, radius: int, ratio: float, coarse: int | None = None, full_radius: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links within one block (right is None) or between two, as a forest of ids.

    left, right: (ids, lanes of shape (lanes, rows), shingle counts). A link has at most `radius` different
    bits in the first `coarse` lanes (None: in all), and at most full_radius in all lanes if that is given.
    ratio: the least quotient of the smaller by the larger count of two linked texts; 0 asks for none.
    """
    ids, lanes, sizes = left
    other = left if right is None else right
    found_a, found_b = np.empty(0, np.int64), np.empty(0, np.int64)
    step = max(1, CELLS // max(1, len(other[0])))
    for at in range(0, len(ids), step):
        to = min(at + step, len(ids))
        first = at if right is None else 0
        total = np.bitwise_count(lanes[0, at:to, None] ^ other[1][0, None, first:])
        if (coarse or len(lanes)) > 3:
            total = total.astype(np.uint16)  # over 255 bits may differ
        for lane in range(1, coarse or len(lanes)):
            total += np.bitwise_count(lanes[lane, at:to, None] ^ other[1][lane, None, first:])
        i, j = np.nonzero(total <= radius)
        i, j = i + at, j + first
        if right is None:
            i, j = i[i < j], j[i < j]
        if ratio:
            m, n = sizes[i], other[2][j]
            ok = np.minimum(m, n) >= ratio * np.maximum(m, n)
            i, j = i[ok], j[ok]
        if full_radius is not None and len(i):
            ok = np.bitwise_count(lanes[:, i] ^ other[1][:, j]).sum(axis=0, dtype=np.int64) <= full_radius
            i, j = i[ok], j[ok]
        if len(i):
            # A forest at every step: links among many copies never pile up.
            found_a, found_b = _forest(np.concatenate([found_a, ids[i]]), np.concatenate([found_b, other[0][j]]))
    return found_a, found_b


def common_counts(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members each of the others, sets without empty ones, has in common with one; all are sorted."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    starts = np.cumsum([0] + [len(x) for x in others[:-1]])
    return np.add.reduceat(one[at] == flat, starts, dtype=np.int64)


def jaccard_links(ids: np.ndarray, lanes: np.ndarray, sets: list[np.ndarray], ratio: float, full_radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs within full_radius whose sets have a Jaccard similarity of at least ratio, a forest.

    Pairs that links found before connect aren't compared; that leaves the components as they are.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    label = np.arange(len(ids))
    found_a, found_b = [], []
    for i in range(len(ids) - 1):
        j = i + 1 + np.nonzero(label[i + 1 :] != label[i])[0]
        j = j[np.minimum(sizes[i], sizes[j]) >= ratio * np.maximum(sizes[i], sizes[j]) - 1e-6]
        j = j[sizes[j] > 0]
        if len(j):
            j = j[np.bitwise_count(lanes[:, i, None] ^ lanes[:, j]).sum(axis=0, dtype=np.int64) <= full_radius]
        while len(j):
            # As many as numpy can hold at once, one at least; what they link is not looked at again.
            take = max(1, int(np.searchsorted(np.cumsum(sizes[j]), CELLS, "right")))
            now, j = j[:take], j[take:]
            both = common_counts(sets[i], [sets[x] for x in now])
            hits = now[both >= ratio * (sizes[i] + sizes[now] - both) - 1e-6]
            if len(hits):
                joined, first = np.unique(label[hits], return_index=True)
                found_a += [ids[i]] * len(first)
                found_b += ids[hits[first]].tolist()
                label[np.isin(label, joined)] = label[i]
                j = j[label[j] != label[i]]
    return np.array(found_a, np.int64), np.array(found_b, np.int64)


def grain_for(radius: int) -> int:
    """How many population counts make a class: 1 for small radii; for large ones, a tile of one count would have very many neighbours."""
    return max(1, radius // 4)


def _tile_key(parts: int, coarse: int, grain: int, ratio: float) -> Column:
    """Classes of the population counts of the parts, and the size class where sizes count: classes two apart differ by more than the ratio."""
    if parts < coarse:
        counts = [sum((F.bit_count(f"l{k}") for k in range(coarse)), F.lit(0))]
    else:
        width = 64 * coarse // parts
        mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
        counts = [F.bit_count(F.shiftrightunsigned(f"l{k}", at).bitwiseAND(mask)) for k in range(coarse) for at in range(0, 64, width)]
    counts = [F.floor(c / grain) for c in counts]
    if ratio:
        counts.append(F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / -math.log(ratio)))
    return F.array(*(c.cast("int") for c in counts))


def tiled_links(prints: DataFrame, lanes: int, radius: int, ratio: float = 0.0, coarse: int | None = None, full_radius: int | None = None, block: int | None = None) -> DataFrame:
    """Links (a, b) that connect all of prints (id, l0.., size) that link as block_links() says.

    Each block pair gives a forest of its links: fewer rows than its members, and the same components.
    The column `pair` names the block pair; a is the same for all of a component within it.
    """
    parts, grain = parts_for(prints.count(), radius, 64 * (coarse or lanes)), grain_for(radius)
    tiled = prints.withColumn("tile", _tile_key(parts, coarse or lanes, grain, ratio))
    blocks_of = F.greatest(F.ceil(F.count("*") / (block or BLOCK)), F.ceil(F.sum("size") / WEIGHT))
    need = tiled.groupBy("tile").agg(blocks_of.alias("n"))
    dealt = tiled.join(need, "tile").withColumn("block", F.pmod(F.xxhash64("id"), "n").cast("int"))
    row = F.struct("id", *(f"l{k}" for k in range(lanes)), "size")
    # Dealt anew by tile and block: left where the join put it, a hot tile would be one task's.
    blocks = stash(dealt.repartition("tile", "block").groupBy("tile", "block").agg(F.collect_list(row).alias("rows")), "simhash-blocks")
    names = blocks.select("tile", "block")
    # Counts in classes k apart differ by (k - 1) x grain + 1 at least.
    near = steps(parts, (radius - 1) // grain + 1 if radius else 0)
    if ratio:
        near = [(*d, c) for d in near for c in (-1, 0, 1) if any(d) or c >= 0]
    offsets = F.array(*(F.array(*map(F.lit, d)) for d in near))
    reach = names.select("tile", "block", F.explode(offsets).alias("d")).select(F.zip_with("tile", "d", lambda x, y: x + y).alias("tile2"), "tile", "block")
    pairs = reach.join(names.select(F.col("tile").alias("tile2"), F.col("block").alias("block2")).hint("merge"), "tile2")
    pairs = pairs.where((F.col("tile") != F.col("tile2")) | (F.col("block") <= F.col("block2")))
    work = pairs.join(blocks.select("tile", "block", F.col("rows").alias("left_rows")), ["tile", "block"])
    work = work.join(blocks.select(F.col("tile").alias("tile2"), F.col("block").alias("block2"), F.col("rows").alias("right_rows")), ["tile2", "block2"])
    work = work.select(((F.col("tile") == F.col("tile2")) & (F.col("block") == F.col("block2"))).alias("same"), F.xxhash64("tile", "block", "tile2", "block2").alias("pair"), "left_rows", "right_rows")

    def unpack(rows: pa.StructArray) -> tuple:
        return (rows.field("id").to_numpy(), np.stack([rows.field(f"l{k}").to_numpy().view(np.uint64) for k in range(lanes)]), rows.field("size").to_numpy())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("left_rows"), batch.column("right_rows")
            same, pair = batch.column("same").to_pylist(), batch.column("pair").to_pylist()
            for n in range(batch.num_rows):
                x, y = block_links(unpack(a[n].values), None if same[n] else unpack(b[n].values), radius, ratio, coarse, full_radius)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array([pair[n]] * len(x), pa.int64())], ["a", "b", "pair"])

    return work.mapInArrow(compare, "a bigint, b bigint, pair bigint")


def confirmed_links(candidates: DataFrame, sets: DataFrame, lanes: int, ratio: float, full_radius: int) -> DataFrame:
    """Links (a, b) between those that tiled_links() joined in one block pair, where the sets are as similar as ratio asks.

    candidates: rows of tiled_links(); sets: (id, l0.., set). A row goes out for each member of a block pair's
    component, never for each pair: what goes out grows with the members, however many are alike.
    """
    member = F.explode(F.array(F.col("a"), F.col("b")))
    members = candidates.select("pair", "a", member.alias("id")).distinct()
    row = F.struct("id", *(f"l{k}" for k in range(lanes)), "set")
    groups = members.join(sets, "id").groupBy("pair", "a").agg(F.collect_list(row).alias("rows")).select("rows")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty((2, 0), np.int64)]
            for n in range(batch.num_rows):
                rows = batch.column("rows")[n].values
                own = [np.frombuffer(x.as_buffer(), np.uint64) if x.is_valid and len(x.as_buffer()) else np.empty(0, np.uint64) for x in rows.field("set")]
                bits = np.stack([rows.field(f"l{k}").to_numpy().view(np.uint64) for k in range(lanes)])
                found.append(np.stack(jaccard_links(rows.field("id").to_numpy(), bits, own, ratio, full_radius)))
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return groups.mapInArrow(confirm, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every end of a link: label is the smallest id of its component.

    Rounds of hooking and jumping: a node's label hooks to the smallest label that any node under it
    sees, then every node takes the label of its label. Each round is a written table; it ends when
    no label changes.
    """
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges = stash(links.where("a <> b").select(both.alias("x")).select("x.a", "x.b").distinct(), "links")
    labels = stash(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("label")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("id").alias("b"), F.col("label").alias("low")), "b").groupBy(F.col("a").alias("id")).agg(F.min("low").alias("low"))
        hooks = seen.join(labels, "id").groupBy("label").agg(F.min("low").alias("low"))
        hooks = stash(hooks.select("label", F.least("label", "low").alias("to")), "hooks")
        # hooks has every label; where a label's own label moved too, follow it one step further.
        far = hooks.select(F.col("label").alias("to"), F.col("to").alias("far"))
        moved = hooks.join(far, "to", "left").select("label", F.least("to", F.coalesce("far", "to")).alias("new"))
        if hooks.where("to < label").isEmpty():
            return labels
        labels = stash(labels.join(moved, "label").select("id", F.col("new").alias("label")), "labels")


def simhash_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle_words: int = 3, radius: int = 2, lanes: int = 1, ratio: float = 0.0) -> DataFrame:
    """One row for each row of docs: (id, lanes, component), component being the smallest id reachable over links.

    Fingerprints link when at most `radius` of their 64 x `lanes` bits differ (and their shingle counts
    have at least the quotient `ratio`). Null and empty texts have fingerprint zero and link like any other;
    equal texts share a fingerprint; a null id counts as larger than any other, so a class of null ids alone
    has a null component. Repeated rows come back as often as they went in.
    """
    made = docs.select(F.col(id).alias("id"), fingerprint_udf(shingle_words, lanes)(F.col(text)).alias("made"))
    names = [f"l{k}" for k in range(lanes)]
    rows = stash(made.select("id", *(F.col("made.lanes")[k].alias(n) for k, n in enumerate(names)), (F.col("made.shingles") if ratio else F.lit(0).cast("long")).alias("size")), "simhash")
    # Equal fingerprints are one node, named by a number that is dense enough to be a long.
    nodes = stash(rows.groupBy(*names, "size").agg(F.min("id").alias("least")).withColumn("id", F.monotonically_increasing_id()), "simhash-nodes")
    links = tiled_links(nodes.select("id", *names, "size"), lanes, radius, ratio, block=NARROW_BLOCK if lanes == 1 else BLOCK)
    labels = components(links)
    named = nodes.join(labels, "id", "left").select("id", "least", F.coalesce("label", "id").alias("label"), *names, "size")
    low = named.groupBy("label").agg(F.min("least").alias("component"))
    classes = named.join(low, "label").select(*names, "size", "component")
    return rows.join(classes, [*names, "size"]).select(F.col("id").alias(id), F.array(*names).alias("lanes"), "component")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash_classes(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("lanes")[0]), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle_words: int = 5, lanes: int = 8, coarse: int = 2, radius: int = 44, full_radius: int = 136, ratio: float = 0.8) -> DataFrame:
    """docs with one row of each class of near-duplicates: the one with the smallest id, then the smallest text hash.

    Near-duplicates are texts whose sets of distinct shingles have a Jaccard similarity of `ratio` or more, and
    what such pairs connect. Fingerprints of these sets name the candidates, the sets themselves decide. At 0.8,
    sets differ in about 19 of the first 128 bits and about 77 of all 512 (24 and 96 where four shingles meet five,
    the worst case); the radii lie 4.5 standard deviations above that worst case. Null and empty texts form one
    class. Null ids come last. Rows that agree in id and text count once.
    """
    marked = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("mark"), set_fingerprint_udf(shingle_words, lanes)(F.col(text)).alias("made"))
    names = [f"l{k}" for k in range(lanes)]
    rows = stash(marked.select("id", "mark", *(F.col("made.lanes")[k].alias(n) for k, n in enumerate(names)), F.col("made.shingles").alias("size"), "made.digest"), "simhash")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "mark")
    # Equal sets are one node; its first row's text is the one that is compared.
    nodes = stash(rows.groupBy(*names, "size", "digest").agg(F.min(rank).alias("first")).withColumn("node", F.monotonically_increasing_id()), "simhash-nodes")
    near = stash(tiled_links(nodes.select(F.col("node").alias("id"), *names, "size"), lanes, radius, ratio, coarse, full_radius), "simhash-candidates")
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = nodes.join(ends, "node").select("node", F.col("first.id").alias("first_id"), F.col("first.mark").alias("first_mark"), *names)
    texts = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    texts = asked.join(texts, F.col("first_id").eqNullSafe(F.col("id")) & (F.col("first_mark") == F.col("mark")))
    texts = texts.groupBy("node", *names).agg(F.first("text").alias("text"))
    sets = texts.select(F.col("node").alias("id"), *names, shingle_set_udf(shingle_words)(F.col("text")).alias("set"))
    labels = components(confirmed_links(near, sets, lanes, ratio, full_radius)).withColumnRenamed("id", "node")
    # Of each label one node's first row wins; all other (id, mark) go.
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    winners = named.groupBy("label").agg(F.min("first").alias("w")).select(F.col("w.id").alias("id"), F.col("w.mark").alias("mark"))
    counted = rows.groupBy("id", "mark").count()
    same = lambda x, y: x["id"].eqNullSafe(y["id"]) & (x["mark"] == y["mark"])
    losers = stash(counted.join(winners, same(counted, winners), "left_anti").select("id", "mark"), "simhash-losers")
    twice = stash(rows.groupBy("id", "mark").count().where("count > 1").select("id", "mark"), "simhash-twice")
    own_id, own_mark = unused(docs, "__id", "__mark")
    own = docs.withColumns({own_mark: F.xxhash64(text), own_id: F.col(id)})
    in_ = lambda x: own[own_id].eqNullSafe(x["id"]) & (own[own_mark] == x["mark"])
    # Always a shuffled join: the rows that go grow with the table, so there is no size up to which to broadcast them.
    gone = losers.hint("merge")
    kept = own.join(gone, in_(gone), "left_anti")
    if not twice.isEmpty():
        once = kept.join(twice, in_(twice), "left_anti")
        more = kept.join(twice, in_(twice), "left_semi")
        kept = once.unionByName(more.dropDuplicates([own_id, own_mark]))
    return kept.select(*docs.columns)
