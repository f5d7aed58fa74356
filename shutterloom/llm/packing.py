"""Packing along a space-filling curve.

Every document gets a vector of hashed character trigrams, projected to three dimensions; its
place on the Hilbert curve through them, with a hash of its id behind it, is its key. Documents
are range-partitioned and sorted by that key, and their ids are laid one after another into
sequences of fixed length, so neighbours in a sequence are neighbours on the curve. Only the last
sequence of a partition is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stash, table
from .sharding import find_cuts
from .tokens import tokenizer

LENGTH = 1024
#: The id that ends a document.
END = 0
BINS = 256
DIMENSIONS, BITS = 3, 13
#: Bits of the id's hash behind the place on the curve: they spread equal texts.
SALT = 24
#: Bytes of ids of a partition, about; the number of partitions follows.
PARTITION_BYTES = 16 << 20
MOST_PARTITIONS = 8192

_PROJECTION = np.random.default_rng(11).standard_normal((BINS, DIMENSIONS))


def vector(text: str | None) -> np.ndarray:
    """Unit vector of hashed trigram counts of the lower-cased UTF-8 bytes; zero if there is no trigram."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    count = np.zeros(BINS, np.int64)
    for at in range(0, max(0, len(data) - 2), 1 << 18):
        part = data[at : at + (1 << 18) + 2]
        # Sums modulo 256 of odd multiples.
        mixed = part[:-2] * np.uint8(177) + part[1:-1] * np.uint8(119) + part[2:] * np.uint8(61)
        count += np.bincount(mixed, minlength=BINS)
    norm = np.sqrt(float(count @ count))
    return count / norm if norm else count.astype(np.float64)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates of `bits` bits; neighbours on it are neighbours in space.

    Coordinates are turned into the transposed index from the top bit down: each level reflects or swaps
    the axes below it, then a Gray code is undone, and the bits of the axes interleave.
    """
    axes = [points[:, k].astype(np.uint64) for k in range(points.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        low = q - one
        for k, axis in enumerate(axes):
            set_ = (axis & q) != 0
            swap = np.where(set_, np.uint64(0), (axes[0] ^ axis) & low)
            axes[0] = np.where(set_, axes[0] ^ low, axes[0] ^ swap)
            if k:
                axes[k] = axis ^ swap
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    turn = np.zeros(len(points), np.uint64)
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        turn = np.where((axes[-1] & q) != 0, turn ^ (q - one), turn)
    axes = [a ^ turn for a in axes]
    out = np.zeros(len(points), np.uint64)
    for level in range(bits - 1, -1, -1):
        for a in axes:
            out = (out << one) | ((a >> np.uint64(level)) & one)
    return out


def curve_keys(ids: list, texts: list[str | None]) -> np.ndarray:
    """63-bit keys: the place of the text's vector on the curve, then bits of a hash of the id."""
    if not texts:
        return np.empty(0, np.int64)
    at = np.stack([vector(t) for t in texts]) @ _PROJECTION
    # The coordinates lie around 0 with a spread of about 1.
    cells = np.clip((at + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    salt = np.array([xxhash.xxh64_intdigest(str(i)) >> (64 - SALT) for i in ids], np.uint64)
    return ((hilbert(cells, BITS) << np.uint64(SALT)) | salt).astype(np.int64)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that the Python objects made of them are few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _lay(ids: np.ndarray, fill: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, offset) of the pieces of a document laid from offset `fill` on."""
    at = 0
    while at < len(ids):
        n = min(len(ids) - at, length - fill)
        yield at, n, fill
        at, fill = at + n, (fill + n) % length


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset) of the packed documents.

    ids are the piece's token ids as little-endian 16-bit numbers; path names the tokenizer file, which
    every executor has. Documents run on from one sequence into the next, so every sequence but the last of
    a partition is full. A null text is packed as the empty one, as its end id alone; repeated rows are
    packed each; a null id is kept; an empty table gives no pieces. Sequences depend on the rows alone.
    """
    plain = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = plain.schema["id"].dataType
    tail = end.to_bytes(2, "little")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = tokenizer(path)
        for batch in _small(batches, 1000):
            keys = curve_keys(batch.column("id").to_pylist(), batch.column("text").to_pylist())
            ids = [x + tail for x in by.ids(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("id"), pa.array(ids, pa.binary())], ["key", "id", "ids"])

    # The texts are read once; keys and ids are kept, in about as many bytes as the texts.
    made = stash(plain.mapInArrow(tokenise, f"key bigint, id {kind.simpleString()}, ids binary"), "packing")
    keyed = made.select(F.shiftleft("key", 1).alias("k1"), F.lit(0).cast("long").alias("k2"), F.octet_length("ids").cast("long").alias("size"))
    parts = max(1, min(MOST_PARTITIONS, -(-(keyed.agg(F.sum("size")).first()[0] or 0) // PARTITION_BYTES)))
    # Cuts at even shares of the ids, from exact counts, so that reruns agree.
    found = find_cuts(keyed, parts, 0.05)[0] if parts > 1 else []
    edges = np.array([int.from_bytes(bytes((*d[:8], *[0] * (8 - len(d[:8])))), "big") >> 1 for d in found], np.int64)

    def part_of(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, key.to_numpy(), side="right").astype(np.int32))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequence, fill = -1, 0, 0
        for batch in _small(batches):
            rows: list[tuple] = []
            at: list[int] = []
            for n, (own, ids) in enumerate(zip(batch.column("part").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                if own != part:
                    part, sequence, fill = own, own << 32, 0
                tokens = np.frombuffer(ids, "<u2")
                for start, count, offset in _lay(tokens, fill, length):
                    at.append(n)
                    rows.append((start, count, ids[2 * start : 2 * (start + count)], len(tokens), sequence, offset))
                    fill = (offset + count) % length
                    if fill == 0:
                        sequence += 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *made], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    dealt = made.withColumn("part", F.arrow_udf(part_of, "int")("key"))
    ordered = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "id", "ids")
    pieces = ordered.mapInArrow(lay, f"id {kind.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return pieces.withColumnRenamed("id", id)


def _checksums(ids: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids.to_pylist()], pa.int64())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with the checksum of each one's ids."""
    small_batches(spark)
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.arrow_udf(_checksums, "bigint")("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
