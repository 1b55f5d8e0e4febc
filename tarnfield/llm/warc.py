"""WARC records and a Merkle fixity audit of replicas, as DataFrame jobs on built-in functions.

Records lie in files at ascending byte offsets. A tree of a file has a leaf hash for each record, and above the leaves a node
for each range of ``fanout ** level`` granules of offsets: the hash of its children's hashes in order, each with its
place. Nodes hang on offsets rather than counts, so a lost record changes only the ranges that hold it.

The audit compares the two replicas' roots and goes down only where they differ, a join of one level's mismatches with the
children below them. Its result is a row for each record of either replica. Records with null file or offset take no part;
a null payload has a hash of its own, apart from that of an empty one. Records that share file and offset are one leaf, the
hash of all of theirs in order; a record that stands twice in one replica and once in the other is thus a mismatch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfield.llm.graph import cut

#: Levels over the leaves: offsets up to ``granule * fanout ** LEVELS``.
FANOUT, LEVELS = 16, 6


def warc_record(uri: Column, date: Column, payload: Column) -> Column:
    """The bytes of a WARC/1.1 resource record, with a digest-derived id; null where the payload is null."""
    body = payload.cast("binary")
    digest = F.sha2(body, 256)
    name = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), name, F.lit(">\r\nWARC-Date: "), date,
        F.lit("\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nWARC-Block-Digest: sha256:"), digest,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def record_digest(record: Column) -> Column:
    """The hash of a record's bytes, and a word for none. Taken where the record is read, so that bodies aren't shuffled."""
    return F.coalesce(F.sha2(record.cast("binary"), 256), F.lit("null"))


def lay_out(records: DataFrame, file: Column, order: list[str], length: str = "length") -> DataFrame:
    """The records with ``file`` and ``offset``: each follows the one before it in its file.

    ``file`` should deal out a bounded number of records to each file, as writers of archives do; then no task
    holds more than such a file's rows.
    """
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("file", file).withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))


def leaves(records: DataFrame, digest: str = "digest") -> DataFrame:
    """file, offset, length, n_records and hash of each leaf, from rows of file, offset, length and record digest."""
    hashed = records.where("file is not null and offset is not null").select("file", "offset", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce(digest, F.lit("null")).alias("hash"))
    # Records at one place are few; of equal ones only the number is kept, so a repeated row stays one small entry.
    counted = hashed.groupBy("file", "offset", "length", "hash").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "hash", "length", F.col("n").cast("string"))))
    return counted.groupBy("file", "offset").agg(F.max("length").alias("length"), F.sum("n").alias("n_records"), F.sha2(F.array_join(parts, ","), 256).alias("hash"))


def parents(nodes: DataFrame, level: int, fanout: int = FANOUT) -> DataFrame:
    """The nodes of the next level: level, file, place and hash. A node has at most ``fanout`` children."""
    children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: F.concat_ws(":", x["place"].cast("string"), x["hash"])), ",")
    return nodes.groupBy("file", F.floor(F.col("place") / fanout).cast("long").alias("up")).agg(F.sha2(children, 256).alias("hash")).select("file", F.col("up").alias("place"), "hash")


def merkle_tree(own: DataFrame, granule: int, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Nodes by level from the granules up to one root a file; the leaves are not among them."""
    ranged = own.select("file", F.floor(F.col("offset") / granule).cast("long").alias("granule"), F.col("offset").alias("place"), "hash")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: F.concat_ws(":", x["place"].cast("string"), x["hash"])), ",")
    out = [cut(ranged.groupBy("file", "granule").agg(F.sha2(joined, 256).alias("hash")).select("file", F.col("granule").alias("place"), "hash"))]
    for level in range(1, levels + 1):
        out.append(parents(out[-1], level, fanout))
        if level < levels and level % 2 == 0:
            out[-1] = cut(out[-1])
    # Whatever lies beyond the top level's range of a file hangs below the same root.
    top = out[-1]
    children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: F.concat_ws(":", x["place"].cast("string"), x["hash"])), ",")
    return [*out, top.groupBy("file").agg(F.sha2(children, 256).alias("hash")).select("file", F.lit(0).cast("long").alias("place"), "hash")]


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes that are in one tree only, or have two hashes."""
    both = left.withColumnRenamed("hash", "one").join(right.withColumnRenamed("hash", "two"), ["file", "place"], "full")
    return both.where(~F.col("one").eqNullSafe(F.col("two"))).select("file", "place")


def fixity_audit(first: DataFrame, second: DataFrame, digest: str = "digest", granule: int = 1 << 16, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """A row for each leaf of either replica: file, offset, length, n_records, hash (of the first replica where it has the
    leaf), and status: ok, changed, lost (missing in the second) or added (missing in the first)."""
    one, two = cut(leaves(first, digest)), cut(leaves(second, digest))
    trees = merkle_tree(one, granule, fanout, levels), merkle_tree(two, granule, fanout, levels)
    bad = _differing(trees[0][-1], trees[1][-1]).select("file")
    for level in range(levels, -1, -1):
        down = lambda nodes, bad=bad, level=level: nodes.join(bad, ["file"] if level == levels else ["file", "up"], "left_semi")
        placed = [t[level].withColumn("up", F.floor(F.col("place") / fanout).cast("long")) for t in trees]
        bad = _differing(*(down(x).select("file", "place", "hash") for x in placed)).withColumnRenamed("place", "up")
        if level % 2:
            bad = cut(bad)
    bad = bad.withColumnRenamed("up", "granule")
    near = lambda x: x.withColumn("granule", F.floor(F.col("offset") / granule).cast("long")).join(bad, ["file", "granule"], "left_semi").drop("granule")
    left, right = near(one).select("file", "offset", F.col("hash").alias("h1")), near(two).select("file", "offset", F.col("hash").alias("h2"))
    located = left.join(right, ["file", "offset"], "full").where(~F.col("h1").eqNullSafe(F.col("h2")))
    located = located.select("file", "offset", F.when(F.col("h2").isNull(), "lost").when(F.col("h1").isNull(), "added").otherwise("changed").alias("status"))
    known = one.unionByName(two.join(located.where("status = 'added'"), ["file", "offset"], "left_semi"))
    return known.join(located, ["file", "offset"], "left").select("file", "offset", "length", "n_records", "hash", F.coalesce("status", F.lit("ok")).alias("status"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC/1.1 files at ``path``: file, offset, length, digest, type, uri, date, payload, and complete.

    Files are split between tasks at record starts, so a large archive isn't read by one task (a compressed one is, and its
    offsets are those of the plain bytes). ``complete`` is false where the bytes after the head are not those that
    Content-Length states, as in a file cut off, or in a payload that has a record's first line in it.
    """
    start = "WARC/1.1\r\n"
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", start).text(path)
    rows = rows.select(F.regexp_extract(meta["file_path"], r"[^/]*$", 0).alias("file"), meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("rest"))
    # What comes before the first record of a file is one entry too: empty in an archive.
    length = F.octet_length("rest").cast("long") + len(start)
    before = Window.partitionBy("path").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("path").orderBy("block", "at")
    rows = rows.withColumns({"length": length, "first": F.row_number().over(order) == 1})
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)) - len(start)).where("not (first and length(rest) = 0)")
    record = F.concat(F.lit(start).cast("binary"), "rest")
    text = F.decode("rest", "ISO-8859-1")
    cut_at = F.instr(text, "\r\n\r\n")
    head = F.concat(F.lit("\r\n"), F.substring(text, F.lit(1), cut_at), F.lit("\r\n"))
    field = lambda name: F.nullif(F.trim(F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)), F.lit(""))
    stated = field("Content-Length").cast("long")
    whole = (cut_at > 0) & (F.octet_length("rest") == cut_at + 3 + stated + 4)
    return rows.select(
        "file", "offset", "length", record_digest(record).alias("digest"), field("WARC-Type").alias("type"), field("WARC-Target-URI").alias("uri"), field("WARC-Date").alias("date"),
        F.when(cut_at > 0, F.substring(F.col("rest"), cut_at + 4, F.coalesce(stated, F.lit(0)).cast("int"))).alias("payload"), F.coalesce(whole, F.lit(False)).alias("complete"),
    )


def archive_index(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", per_file: int = 256) -> DataFrame:
    """``pages`` as archive files of ``per_file`` consecutive page ids, without the bodies: page_id, file, offset, length and
    digest of each record, and ``hurt``, its digest with one byte changed.

    Null ids have files of their own. A file of many more records, as repeated and null ids make, is dealt out to several,
    numbered after its name; which of them a record falls into is fixed only once the index is written.
    """
    file = F.concat(F.lit("pages-"), F.lpad(F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1)).cast("string"), 12, "0"), F.lit(".warc"))
    record = warc_record(F.col("url"), F.lit(date), F.col("html"))
    rows = pages.select("page_id", record.alias("record"))
    hurt = F.concat(F.substring("record", 1, 40), F.lit("#").cast("binary"), F.expr("substring(record, 42)"))
    rows = rows.select("page_id", F.coalesce(F.octet_length("record"), F.lit(0)).cast("long").alias("length"), record_digest(F.col("record")).alias("digest"), record_digest(hurt).alias("hurt"))
    rows = rows.withColumn("name", file)
    large = rows.groupBy("name").agg(F.count("*").alias("rows")).where(F.col("rows") > 4 * per_file)
    rows = rows.join(large, "name", "left")
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("rows") / per_file))
    file = F.when(F.col("rows").isNull(), F.col("name")).otherwise(F.concat("name", F.lit("."), part.cast("string")))
    rows = rows.withColumn("file", file).drop("name", "rows")
    return lay_out(rows, F.col("file"), ["page_id", "digest"])


def damaged(index: DataFrame) -> DataFrame:
    """A replica with damage planted by rule: of each 101 page ids one record has a byte changed and one is lost."""
    rule = F.pmod(F.col("page_id"), F.lit(101))
    return index.where(F.coalesce(rule != 1, F.lit(True))).withColumn("digest", F.when(rule == 0, F.col("hurt")).otherwise(F.col("digest")))


def audit_query(pages: DataFrame) -> DataFrame:
    """Audits the archive of ``pages`` against a replica with planted damage."""
    index = cut(archive_index(pages))
    return fixity_audit(index, damaged(index))
