"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a key of 128 bits: a hash of the text, then a hash of the id. The cuts
between shards are sought by counting exact bytes: every round counts the bytes below each of
256 probes inside every open interval, in one aggregation over all partitions, and narrows the
interval around its target, until each cut lies within the tolerance or no key is left between
its probes. Then the rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

#: Bits of the key that a round resolves: 2**8 probes in each open interval.
STEP = 8
#: A cut may be off by this share of a mean shard.
TOLERANCE = 0.001
#: Rows that one task numbers, about.
RUN = 1_000_000


def _digit(depth: int) -> Column:
    """The depth-th group of STEP bits of the key, text hash first."""
    word, shift = ("k1", depth * STEP) if depth * STEP < 64 else ("k2", depth * STEP - 64)
    return F.shiftrightunsigned(word, 64 - STEP - shift).bitwiseAND(F.lit((1 << STEP) - 1).cast("long"))


def _prefix(digits: tuple[int, ...]) -> tuple[int, int]:
    """The digits as the leading bits of the two words of the key."""
    first, second = digits[: 64 // STEP], digits[64 // STEP :]
    top, rest = int.from_bytes(bytes(first), "big"), int.from_bytes(bytes(second), "big")
    return (top - (1 << 64) if top >= 1 << 63 else top), (rest - (1 << 64) if rest >= 1 << 63 else rest)


def _leading(word: str, bits: int) -> Column:
    """The leading bits of a word, as _prefix has them; 0 for none."""
    if bits <= 0:
        return F.lit(0).cast("long")
    return F.col(word) if bits >= 64 else F.shiftrightunsigned(word, 64 - bits)


def find_cuts(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[tuple[int, ...]], int]:
    """The first key digits of shards 1, 2, ... and the number of rounds.

    keyed has k1, k2 (the key) and size. The driver gets at most 256 sums for each cut that is still
    open, so at most 256 x (shards - 1) numbers a round, whatever the table's size.
    """
    sums = {(): keyed.agg(F.sum("size")).first()[0] or 0}
    total = sums[()]
    slack = tolerance * total / shards
    # An open cut: the digits of the interval that holds its target, and the bytes below that interval.
    open_cuts = {j: ((), 0) for j in range(1, shards)} if total else {}
    cuts: dict[int, tuple[int, ...]] = {} if total else {j: () for j in range(1, shards)}
    rounds = 0
    while open_cuts:
        depth = rounds
        rounds += 1
        held = sorted({digits for digits, _ in open_cuts.values()})
        # The open intervals, at most one a cut, meet the rows by the leading bits of the key.
        listed = ", ".join("(BIGINT('{}'), BIGINT('{}'), {})".format(*_prefix(digits), n) for n, digits in enumerate(held))
        names = keyed.sparkSession.sql(f"SELECT * FROM VALUES {listed} AS t(p1, p2, held)")
        bits = depth * STEP
        rows = keyed.select(_leading("k1", bits).alias("p1"), _leading("k2", bits - 64).alias("p2"), _digit(depth).alias("digit"), "size")
        counted = rows.join(F.broadcast(names), ["p1", "p2"])
        found: dict[int, list] = {}
        for n, digit, size in counted.groupBy("held", "digit").agg(F.sum("size")).collect():
            found.setdefault(n, []).append((digit, size))
        for j, (digits, below) in list(open_cuts.items()):
            target = j * total / shards
            at, best = below, None
            for digit, size in sorted(found.get(held.index(digits), [])):
                # The boundary before this digit, and whether the target lies inside it.
                if best is None or abs(at - target) < abs(best[0] - target):
                    best = (at, (*digits, digit))
                inside = at <= target < at + size
                if inside:
                    open_cuts[j] = ((*digits, digit), at)
                at += size
            last = (depth + 1) * STEP >= 128
            if best is not None and (abs(best[0] - target) <= slack or last):
                cuts[j] = best[1]
                del open_cuts[j]
    return [cuts[j] for j in range(1, shards)], rounds


def _at_or_after(digits: tuple[int, ...]) -> Column:
    """Whether the key is not below these digits, followed by zeros; hashes compare as unsigned."""
    if not digits:
        return F.lit(True)
    words = [int.from_bytes(bytes((*part, *[0] * (64 // STEP - len(part)))), "big") - (1 << 63) for part in (digits[: 64 // STEP], digits[64 // STEP :])]
    k1, k2 = (F.col(k).bitwiseXOR(F.lit(-(1 << 63)).cast("long")) for k in ("k1", "k2"))
    return (k1 > words[0]) | ((k1 == words[0]) & (k2 >= words[1]))


def shard_by_bytes(docs: DataFrame, shards: int = 16, id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row of docs, shards being near equal in bytes.

    Size is the text's UTF-8 bytes plus one; a null text has one and the checksum of no bytes. Equal
    texts lie in one shard unless a cut has to fall among them to keep the sizes equal. Rows that agree
    in text and id are one key and stay together. Slots count from 0 without gaps in each shard; an
    empty table has no rows. Only these five columns come back, so others in docs can't clash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = stash(
        docs.select(
            F.col(id).alias("id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("crc"),
            F.xxhash64(body).alias("k1"),
            F.xxhash64(F.col(id), F.lit("shard")).alias("k2"),
        ),
        "sharding",
    )
    cuts, _ = find_cuts(keyed, shards, tolerance)
    rows = keyed.count()
    shard = sum((_at_or_after(c).cast("int") for c in cuts), F.lit(0))
    # The one exchange: by shard and run, runs being even slices of a shard by the hash of the id.
    runs = max(1, -(-rows // shards // RUN), min(16, rows // 1000))
    placed = keyed.select("*", shard.alias("shard"), F.pmod("k2", F.lit(runs)).alias("run"))
    lengths = placed.groupBy("shard", "run").count()
    ahead = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = lengths.select("shard", "run", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    order = F.row_number().over(Window.partitionBy("shard", "run").orderBy("k1", "k2", "id"))
    numbered = placed.withColumn("order", order).join(before, ["shard", "run"])
    return numbered.select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("order") - 1).alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards near equal in bytes."""
    done = shard_by_bytes(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
