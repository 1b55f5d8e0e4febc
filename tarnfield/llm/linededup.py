"""Line dedup over levelled sorted runs of line hashes, on built-in functions only.

The index is a set of runs: tables of (h1, h2, docs, last), one row a line key, bucketed and sorted by the key's 128-bit hash.
Every key stands in one run. A new batch of keys is written in the same buckets and merge-anti-joined with one run after the
other, without a shuffle of either side; what is left is new and becomes a run of level 0. The rest, keys that a run has
already, is kept as the batch's repeats, with the batch's own counts. ``fanout`` runs of a level are compacted to one of
the next. Once all batches are in, the repeats' counts are merged into the runs, and keys in enough documents are frequent.

A key is the line without spaces at its ends, A-Z lowered. Keys are compared by two 64-bit hashes with different seeds: among
10^12 lines two different keys share both with a chance below 10^-14.

Null and empty texts are one empty line. Very long texts are read whole: what a row holds is its own lines. Rows that
repeat an id count as one document; a frequent key stays in all rows of its largest id, and a repeated row gives a repeated result.
A row without an id counts as no document and keeps all its lines. An empty table gives no rows, and extra columns stay as
they are, whatever their names.
"""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.graph import shared_folder
from tarnfield.llm.textkit import fresh_names

#: Space, tab, line feed, vertical tab, form feed, carriage return.
_SPACES = " \t\n\x0b\f\r"
_HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without spaces at its ends, A-Z lowered and no other letter changed."""
    bare = F.btrim(line, F.lit(_SPACES))
    plain = F.octet_length(bare) == F.length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_keys(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(id, row, pos, h1, h2) of each line whose key has ``min_chars`` code points; ``row`` tells rows of one id apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("row"), F.posexplode(text_lines(F.col(text))).alias("pos", "line"))
    keys = lines.where(F.length("line") >= min_chars).select("id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """The runs in a folder that driver and executors share. ``buckets`` is the same for all, so that they merge as they lie."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 2, buckets: int | None = None):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.repeats: list[str] = []
        self._mark, self._written = uuid.uuid4().hex, 0

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """Adds a batch of (h1, h2, docs, last) with distinct keys. Documents of one batch may not be in another."""
        batch, runs = self._write(keys), self.runs()
        if runs:
            fresh = self._write(reduce(self._without, runs, self.spark.table(batch)))
            self.repeats.append(self._write(self._without(self.spark.table(batch), fresh)))
            self._drop([batch])
            batch = fresh
        self._push(batch, 0)

    def totals(self) -> DataFrame:
        """Each key once, with the documents of all batches that have it and the largest id among them."""
        more = self.spark.createDataFrame([], self.spark.table(self.runs()[0]).schema)
        for name in self.repeats:
            more = more.unionByName(self.spark.table(name))
        more = more.groupBy(_HASH).agg(F.sum("docs").alias("more"), F.max("last").alias("later"))
        parts = [self.spark.table(name).join(more.hint("merge"), _HASH, "left") for name in self.runs()]
        both = reduce(DataFrame.unionByName, parts)
        return both.select(*_HASH, (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("last", "later").alias("last"))

    def drop(self) -> None:
        """Deletes the runs."""
        self._drop(self.runs() + self.repeats)

    def _without(self, keys: DataFrame, run: str) -> DataFrame:
        return keys.join(self.spark.table(run).select(_HASH).hint("merge"), _HASH, "left_anti")

    def _push(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self._write(reduce(DataFrame.unionByName, map(self.spark.table, full)).repartition(self.buckets, *_HASH))
            self._drop(full)
            self._push(merged, level + 1)

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{self._mark}_{self._written}"
        self._written += 1
        rows.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 5, min_chars: int = 40, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` without the lines whose keys are in ``min_docs`` documents, but for those of the largest id that has the key.

    Two columns more: the lines before, ``n_lines``, and those dropped, ``n_dropped`` (with underscores before them where the
    table has such columns). The table is dealt to ``batches`` by hash of the id, each added to the runs in turn.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    long_keys(docs, doc_id, text, min_chars).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(f"{folder}/keys")
    keys = spark.read.schema(f"id {docs.schema[doc_id].dataType.simpleString()}, row long, pos int, h1 long, h2 long, batch int").parquet(f"{folder}/keys")
    runs = LineRuns(spark, folder, fanout)
    for i in range(batches):
        runs.add(keys.where(F.col("batch") == i).groupBy(_HASH).agg(F.count_distinct("id").alias("docs"), F.max("id").alias("last")))
    runs.totals().where(F.col("docs") >= min_docs).select(*_HASH, "last").write.parquet(f"{folder}/frequent")
    runs.drop()
    frequent = spark.read.parquet(f"{folder}/frequent")
    # A frequent key may hold a third of all lines: both sides are shuffled, so that Spark can split such a partition.
    gone = keys.join(frequent, _HASH).where("id <> last").groupBy("id", "row").agg(F.collect_set("pos").alias("gone"))
    own, row, drops, before, dropped = fresh_names(docs.columns, "own_id", "row", "gone", "n_lines", "n_dropped")
    gone = gone.select(F.col("id").alias(own), F.col("row").alias(row), F.col("gone").alias(drops))
    body = F.coalesce(F.col(text), F.lit(""))
    joined = docs.withColumn(row, F.xxhash64(body)).join(gone.withColumnRenamed(row, f"{row}_"), (F.col(doc_id) == F.col(own)) & (F.col(row) == F.col(f"{row}_")), "left")
    lines = text_lines(F.col(text))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drops))
    kept = F.when(F.col(drops).isNull(), body).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    new = {before: F.size(lines), dropped: F.coalesce(F.size(drops), F.lit(0))}
    return joined.select(*[kept.alias(c) if c == text else F.col(c) for c in docs.columns], *[v.cast("long").alias(k) for k, v in new.items()])


def line_digest(docs: DataFrame) -> DataFrame:
    found = dedup_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
