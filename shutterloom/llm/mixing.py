"""Mixing sources to target weights, with DataFrame functions only.

Each source's words, its documents in pseudorandom order, form one stream that is cut into blocks
of fixed length. The mix is a list of slots, each to be filled by one block. How many slots every
output shard gets from every source is drawn multinomially, given the source's total; a source's
slots run through a pseudorandom permutation of its block indices, one permutation for each pass
over the source; blocks and slots then join by index, which gives the words of every output shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table, unused, word_count

#: Words of a block.
BLOCK = 64
#: Slots that one task makes at a time.
CHUNK = 1 << 15
#: Documents of a stream are numbered in slices of about so many rows, 64 slices at least.
SLICE_ROWS = 100_000
#: Weights by the order of the sources, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sources: DataFrame, share: float = 1.5, passes: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with target: share of all sizes, split by weight, none above passes x its size.

    What a full source can't take goes to the others by weight until none is above; that is one level
    L with target = min(passes x size, L x weight), found from the sources in order of cap by weight.
    Windows run over one row for each source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    weighed = sources.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * passes)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole) * share
    levels = weighed.withColumn("level", (total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(onward))
    # With the sources before this one full, the others share this level. It rises while the next source would
    # be above its cap and falls after that, so the largest is the one that holds.
    return levels.select("source", "source_size", F.least("cap", F.max("level").over(whole) * F.col("weight")).alias("target"))


def _gcd(a: Column, b: Column) -> Column:
    """Euclid in 92 steps, enough for 64 bits; for a few rows a source."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), (s.a % F.when(s.b == 0, 1).otherwise(s.b)).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step).a


def mix_plan(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, passes: float = 2.0, block: int = BLOCK, shards: int = 64, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized rows, pieces, slots) of the mix.

    sized: rid, id, mark (a hash of the text), source, size, source_size, target. pieces: rid, source, block,
    start, end, from, where [start, end) of the block are words of row rid, `from` on. slots: source, pass,
    shard, ordinal, block, take, where the first `take` words of the block go into the mix; only the last slot of a source takes less than a block.
    Every block is used at most `passes` times. Reruns agree: all draws hash values of the rows.
    """
    plain = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text), F.lit(seed)).alias("mark"))
    counted = stash(plain, "mix-sizes")
    # A power of two slices by the first bits of a hash, so that a window of one stays small however large a source is.
    bits = max(6, math.ceil(math.log2(max(1, counted.count()) / SLICE_ROWS)))
    by_source = counted.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stash(targets(by_source, share, passes).select("*", F.round("target").cast("long").alias("demand")), "mix-targets")

    # The streams: slices of a source by hash, in order; a row starts where the rows before it end.
    key = F.xxhash64("id", "mark", F.lit(seed))
    sliced = counted.withColumn("key", key).withColumn("slice", F.shiftrightunsigned("key", 64 - bits))
    lengths = sliced.groupBy("source", "slice").agg(F.sum("size").alias("length"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select(F.col("source").alias("s"), F.col("slice").alias("c"), F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "slice").orderBy("key", "id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("c"))).drop("s", "c")
    sized = placed.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sized = sized.select(F.xxhash64("id", "mark", "source", F.col("offset") + F.col("before")).alias("rid"), "id", "mark", "source", "size", "source_size", "target", (F.col("offset") + F.col("before")).alias("at"))
    sized = stash(sized, "mix-streams")
    held = sized.where("size > 0").select("rid", "source", "at", F.col("size"), F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    edge = F.col("block") * block
    pieces = held.select("rid", "source", "block", F.greatest(F.lit(0).cast("long"), F.col("at") - edge).alias("start"), F.least(F.lit(block).cast("long"), F.col("at") + F.col("size") - edge).alias("end"), F.greatest(F.lit(0).cast("long"), edge - F.col("at")).alias("from"))

    # A pass: full blocks permuted by i -> (a i + b) mod n with a coprime to n, then the short block if there is one.
    size = F.col("source_size")
    runs = goals.where("demand > 0 and source_size > 0").select("source", "source_size", F.floor(size / block).alias("full"), F.ceil(size / block).alias("blocks"), F.explode(F.sequence(F.lit(0), F.floor((F.col("demand") - 1) / size))).alias("pass"), "demand")
    runs = runs.withColumn("want", F.least(size, F.col("demand") - F.col("pass") * size))
    n = F.greatest(F.col("full"), F.lit(1))
    draw = F.pmod(F.xxhash64("source", "pass", F.lit(seed)), n)
    tries = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda k: F.pmod(draw + k, n))
    runs = runs.withColumn("a", F.coalesce(F.filter(tries, lambda x: _gcd(x, n) == 1)[0], F.lit(1).cast("long"))).withColumn("b", F.pmod(F.xxhash64("source", "pass", F.lit(seed + 1)), n))
    chunks = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("want") - 1) / block), F.lit(CHUNK).cast("long"))).alias("first"))
    # A given number of partitions: the chunks are few bytes now and many rows a step later.
    chunks = chunks.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "pass", "first")
    each = chunks.select("*", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + CHUNK - 1, F.floor((F.col("want") - 1) / block)))).alias("i"))
    wide = "decimal(19,0)"
    permuted = ((F.col("a").cast(wide) * F.col("i").cast(wide) + F.col("b").cast(wide)) % n.cast(wide)).cast("long")
    index = F.when(F.col("i") < F.col("full"), permuted).otherwise(F.col("i"))
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - index * block)
    slots = each.select("source", "pass", (F.col("pass") * F.col("blocks") + F.col("i")).alias("ordinal"), index.alias("block"), F.least(length, F.col("want") - F.col("i") * block).alias("take"))
    # Given a source's total, throwing each of its slots into a uniformly drawn shard draws the shards' counts multinomially.
    slots = slots.withColumn("shard", F.pmod(F.xxhash64("source", "ordinal", F.lit(seed + 2)), F.lit(shards)).cast("int"))
    return sized, pieces, slots


def shard_counts(slots: DataFrame) -> DataFrame:
    """(shard, source, slots, words): the drawn counts of every output shard."""
    return slots.groupBy("shard", "source").agg(F.count("*").alias("slots"), F.sum("take").alias("words"))


def mixed_words(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """(rid, shards): the join of blocks and slots by index; shards lists (shard, words), the words of the row that each output shard takes."""
    # Spark takes the slots for as small as the table of sources that they come from; the hint keeps them from a broadcast.
    uses = slots.groupBy("source", "block").agg(F.collect_list(F.struct("shard", "take")).alias("uses"))
    met = pieces.join(uses.select(F.col("source").alias("s"), F.col("block").alias("x"), "uses").hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("x")))
    words = lambda use: F.least(F.col("end"), use["take"]) - F.col("start")
    got = F.transform(F.filter("uses", lambda use: words(use) > 0), lambda use: F.struct(use["shard"].alias("shard"), words(use).alias("words")))
    lists = met.groupBy("rid").agg(F.flatten(F.collect_list(got)).alias("got"))
    zero = F.lit(0).cast("long")
    of = lambda shard: F.aggregate(F.filter("got", lambda x: x["shard"] == shard), zero, lambda sum_, x: sum_ + x["words"])
    shards = F.array_sort(F.array_distinct(F.transform("got", lambda x: x["shard"])))
    return lists.select("rid", F.transform(shards, lambda shard: F.struct(shard.alias("shard"), of(shard).alias("words"))).alias("shards"))


def mix(docs: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """(id, source, size, source_size, target, taken, shards) of every row of docs.

    shards lists (shard, words): how many of the row's words each output shard takes; taken is their sum. Null and empty texts have size 0 and give nothing; a null source is a source of its own, after all
    others; repeated rows are rows of their own; an empty table gives no rows.
    """
    sized, pieces, slots = mix_plan(docs, id, **options)
    # Rows that share an rid agree in every column and in position, so they hold no words.
    words = mixed_words(pieces, slots)
    done = sized.join(words.hint("merge"), "rid", "left").withColumn("shards", F.coalesce("shards", F.array().cast("array<struct<shard:int,words:bigint>>")))
    taken = F.aggregate("shards", F.lit(0).cast("long"), lambda sum_, x: sum_ + x["words"])
    return done.select(F.col("id").alias(id), "source", "size", "source_size", "target", taken.alias("taken"), "shards")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, in all and by output shard (shard:words, comma-joined)."""
    listed = F.array_join(F.transform("shards", lambda x: F.concat_ws(":", x["shard"].cast("string"), x["words"].cast("string"))), ",")
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", listed.alias("shard_words"))


def mix_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", length: str | None = "n_chars", seed: int = 7, **options) -> DataFrame:
    """The mix as rows with the columns of docs: a row for each pass that takes words of a document, with those words.

    A pass that takes all words keeps the text as it is; else the text is the taken words, space-joined, in
    their order. Documents of which no words are taken have no row: those of sources above their target in
    part, and texts without words. Rows that agree in id, source and text count once. `length`, if docs has
    it, is the new number of characters.
    """
    mark = F.xxhash64(F.col(text), F.lit(seed))
    names = docs.columns
    own_id, own_mark, own_source, passes, each_pass, own_text_mark = unused(docs, "__id", "__m", "__s", "__passes", "__pass", "__mark")
    twice = docs.groupBy(F.col(id).alias("i"), F.col(source).alias("s"), mark.alias("m")).count().where("count > 1")
    if not twice.isEmpty():
        docs = docs.withColumn(own_text_mark, mark).dropDuplicates([id, source, own_text_mark]).select(*names)
        docs = stash(docs, "mix-documents")
    sized, pieces, slots = mix_plan(docs, id, text, source, seed=seed, **options)
    zero = F.lit(0).cast("long")
    uses = slots.select(F.col("source").alias("s"), F.col("block").alias("x"), "pass", "take").hint("merge")
    met = pieces.join(uses, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("x")))
    got = met.select("rid", "pass", "from", F.greatest(zero, F.least(F.col("end"), F.col("take")) - F.col("start")).alias("n")).where("n > 0")
    takes = got.groupBy("rid", "pass").agg(F.sum("n").alias("taken"), F.sort_array(F.collect_list(F.struct("from", "n"))).alias("ranges"))
    plan = sized.select("rid", "id", "mark", "source", "size").join(takes.hint("merge"), "rid")
    plan = plan.groupBy("id", "mark", "source", "size").agg(F.collect_list(F.struct("pass", "taken", F.when(F.col("taken") < F.col("size"), F.col("ranges")).alias("ranges"))).alias(passes))
    plan = plan.select(F.col("id").alias(own_id), F.col("mark").alias(own_mark), F.col("source").alias(own_source), passes)
    own = docs.withColumn(own_text_mark, mark)
    joined = own.join(plan.hint("merge"), own[id].eqNullSafe(F.col(own_id)) & (F.col(own_text_mark) == F.col(own_mark)) & own[source].eqNullSafe(F.col(own_source)))
    each = joined.select(*(own[c] for c in names), F.explode(passes).alias(each_pass))
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # The words are split once for each row: the outer transform binds them to a variable of the inner one.
    cut = lambda w: F.array_join(F.transform(f"{each_pass}.ranges", lambda r: F.array_join(F.slice(w, (r["from"] + 1).cast("int"), r["n"].cast("int")), " ")), " ")
    new = F.when(F.col(f"{each_pass}.ranges").isNull(), F.col(text)).otherwise(F.transform(F.array(words), cut)[0])
    out = each.withColumn(text, new)
    if length and length in names:
        out = out.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return out.select(*names)
