"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are never recomputed: inserts, deletes and
revised counts of documents become signed additions, summed by key within their batch. A batch is
a folder of its own, written whole or not at all under the batch's id, so committing it again
changes nothing. Compaction folds batches into a total that names them; the rollup is the last total
and the batches since.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, small_batches, stash, table, word_count
from .tokens import tokenizer

KEY = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


class TokenLedger:
    """Batches of signed deltas in a folder that all executors share.

    A batch is the folder of its id. `_total-<n>` is a total up to some point: the sums, and the list of the batches in
    it; the one with the largest n holds. Folders are put in place by a rename that refuses an existing target, which is
    atomic on HDFS and local disks; object stores without such a rename need a committer of their own.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _place(self, aside: str, name: str) -> bool:
        """Renames; False if there is something of that name already. What another writer was faster with stays as it is."""
        files, jvm = self._files(), self.spark._jvm
        source = self._path(aside)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(files.makeQualified(source), files.makeQualified(self._path(name)), options)
        except Py4JJavaError:
            if not files.exists(self._path(name)):
                raise
            files.delete(source, True)
            return False
        return True

    def _folders(self) -> list[str]:
        files = self._files()
        if not files.exists(self._path()):
            return []
        return sorted(x.getPath().getName() for x in files.listStatus(self._path()) if x.isDirectory())

    def _names(self, total: str | None) -> DataFrame:
        """The batches that a total stands for."""
        return self.spark.read.schema("batch string").parquet(f"{self.folder}/{total}/batches") if total else self.spark.createDataFrame([], "batch string")

    def _within(self, total: str | None, names: list[str]) -> list[str]:
        """Those of the names that a total stands for; the total's own list stays where it lies."""
        if not total or not names:
            return []
        asked = self.spark.createDataFrame([(n,) for n in names], "batch string")
        return [r[0] for r in self._names(total).join(asked, "batch", "left_semi").collect()]

    def _state(self) -> tuple[str | None, list[str], list[str]]:
        """The total that holds, and of the batches with a folder those that are in it and those beside it."""
        found, files = self._folders(), self._files()
        total = max((n for n in found if n.startswith("_total-")), key=lambda n: int(n.split("-")[1]), default=None)
        whole = [n for n in found if not n.startswith("_") and files.exists(self._path(n, "_SUCCESS"))]
        within = set(self._within(total, whole))
        return total, sorted(within), [n for n in whole if n not in within]

    def committed(self) -> DataFrame:
        """(batch): ids of the committed batches."""
        total, _, beside = self._state()
        return self._names(total).unionByName(self.spark.createDataFrame([(n,) for n in beside], "batch string")).distinct()

    def is_committed(self, batch: str) -> bool:
        """Whether the batch counts already: by its own folder, or by the total's list, of which only its row is read."""
        found, files = self._folders(), self._files()
        if batch in found and files.exists(self._path(batch, "_SUCCESS")):
            return True
        total = max((n for n in found if n.startswith("_total-")), key=lambda n: int(n.split("-")[1]), default=None)
        return bool(total) and not self._names(total).where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was committed before, and then nothing is read or written.

        changes: change ("insert", "delete" or "revise"), source, lang, tokenizer, tokens (of the document as
        inserted or deleted, or revised to) and old_tokens (revised from; else unused). Null counts are 0;
        null keys are keys of their own. The sum is made before the shuffle, so a hot key is a row a task.
        Every attempt writes a folder of its own, which is renamed into place: a batch is seen whole or not at all, and
        of two writers of one batch the second gets False.
        """
        if batch.startswith("_") or not batch.replace("_", "").replace("-", "").isalnum():
            raise ValueError(f"a batch id is letters, digits, _ and -: {batch}")
        if self.is_committed(batch):
            return False
        tokens, old = (F.coalesce(F.col(c), F.lit(0)) for c in ("tokens", "old_tokens"))
        kind = F.col("change")
        known = F.when(kind.isin("insert", "delete", "revise"), kind).otherwise(F.raise_error(F.concat(F.lit("no such change: "), F.coalesce(kind, F.lit("null")))))
        signed = changes.withColumn("change", known).select(
            *KEY,
            F.when(kind == "insert", 1).when(kind == "delete", -1).otherwise(0).alias("docs"),
            F.when(kind == "insert", tokens).when(kind == "delete", -tokens).otherwise(tokens - old).alias("tokens"),
        )
        aside = f"_writing-{uuid.uuid4().hex}"
        _sums(signed).write.parquet(f"{self.folder}/{aside}")
        return self._place(aside, batch)

    def compact(self) -> bool:
        """Fold all committed batches into a new total, so that a rollup reads one row a key and what came since.

        False if there is nothing new, or if another total was put in place meanwhile. Offering a folded batch again still
        changes nothing: the total names it. The folders that the new total stands for stay for readers that have begun;
        sweep() takes them away.
        """
        total, _, beside = self._state()
        if not beside:
            return False
        number = int(total.split("-")[1]) + 1 if total else 1
        aside = f"_writing-{uuid.uuid4().hex}"
        self._deltas(total, beside).write.parquet(f"{self.folder}/{aside}/sums")
        fresh = self.spark.createDataFrame([(b,) for b in beside], "batch string").coalesce(1)
        # In order of id, so that looking for one skips the others' row groups.
        self._names(total).unionByName(fresh).sort("batch").write.parquet(f"{self.folder}/{aside}/batches")
        return self._place(aside, f"_total-{number}")

    def sweep(self) -> None:
        """Delete folders of batches and totals that the present total stands for."""
        total, within, _ = self._state()
        old = {n for n in self._folders() if n.startswith("_total-") and n != total} | set(within)
        for name in old:
            self._files().delete(self._path(name), True)

    def _deltas(self, total: str | None, beside: list[str]) -> DataFrame:
        places = [f"{self.folder}/{b}" for b in beside] + ([f"{self.folder}/{total}/sums"] if total else [])
        return _sums(self.spark.read.schema(_DELTA).parquet(*places)) if places else self.spark.createDataFrame([], _DELTA)

    def rollup(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches; keys whose sums are all 0 have no row."""
        total, _, beside = self._state()
        return self._deltas(total, beside)


def _sums(deltas: DataFrame) -> DataFrame:
    sums = deltas.groupBy(*KEY).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
    return sums.where("docs <> 0 or tokens <> 0")


def _counter(path: str):
    def counts(text: pa.Array) -> pa.Array:
        return pc.divide(pc.binary_length(tokenizer(path).ids(text)), 2)

    return F.arrow_udf(counts, "bigint")


def token_count(path: str, text: str = "text"):
    """Number of token ids of the column by the tokenizer file `path`; 0 for null."""
    return _counter(path)(F.col(text))


def without_repeated_lines(text: str = "text"):
    """The text with each line once, at its first place."""
    return F.array_join(F.array_distinct(F.split(F.col(text), "\n")), "\n")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after three batches under two tokenizer versions, each batch offered twice, compacted between.

    The first inserts every document, the second revises those that shrink when repeated lines go, the
    third deletes all copies of a text but the one with the smallest id.
    """
    small_batches(spark)
    import public_tokenizers

    bpe = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    shorter = F.when(F.col("text").contains("\n"), without_repeated_lines())
    plain = docs.withColumn("revised", F.when(F.length(shorter) < F.length("text"), shorter))
    counted = stash(
        plain.select(
            "doc_id",
            "source",
            "lang",
            F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"),
            F.col("revised").isNotNull().alias("is_revised"),
            F.array(
                F.struct(F.lit("byte_bpe_50k").alias("tokenizer"), token_count(bpe).alias("tokens"), token_count(bpe, "revised").alias("new_tokens")),
                F.struct(F.lit("words").alias("tokenizer"), word_count(F.col("text")).alias("tokens"), word_count(F.col("revised")).alias("new_tokens")),
            ).alias("counts"),
        ),
        "token-counts",
    )
    # Written, so that the join deals both sides itself and AQE can split a hot text's side.
    first = stash(counted.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "token-copies")
    copies = counted.join(first, "digest").where("doc_id > first")
    each = lambda rows: rows.select("source", "lang", "is_revised", F.explode("counts").alias("c")).select("source", "lang", "is_revised", "c.*")
    last = F.when(F.col("is_revised"), F.col("new_tokens")).otherwise(F.col("tokens"))
    batches = {
        "1-insert": each(counted).withColumn("change", F.lit("insert")).withColumn("old_tokens", F.lit(0)),
        "2-revise": each(counted.where("is_revised")).select(*KEY, F.lit("revise").alias("change"), F.col("new_tokens").alias("tokens"), F.col("tokens").alias("old_tokens")),
        "3-delete": each(copies).select(*KEY, F.lit("delete").alias("change"), last.alias("tokens"), F.lit(0).alias("old_tokens")),
    }
    ledger = TokenLedger(spark, f"{shared_folder(spark)}/token-ledger-{uuid.uuid4().hex}")
    for name, changes in batches.items():
        ledger.commit(name, changes)
        if name == "2-revise":
            ledger.compact()
    for name, changes in batches.items():
        ledger.commit(name, changes)
    return ledger.rollup()

