"""N-gram Jaccard join: near duplicates through a blocked sparse product of the document by n-gram incidence.

Links are exact: two documents link when ``100 * intersection >= percent * union`` of their sets of word shingles.

1. Equal sets are one class each, so copies never meet in pairs.
2. A class can link only if other classes share ``percent`` of its shingles. Which shingles are shared is found by sending
   32 bits of every shingle once, packed, to a range of the hash space; the number of ranges grows with the table, so a
   range stays of one size. A shingle that one chunk of documents holds several times is sent once.
3. The classes left over make up the incidence matrix. Its shingles are counted exactly and ordered rare ones first; a
   class can only link to one with which it shares one of its first ``n - ceil(n * percent / 100) + 1`` shingles,
   those held by no other class included. Only that part of the matrix is multiplied.
4. Columns of few rows, most of those that link documents, are multiplied first, and the overlaps of each pair of rows summed.
   A longer column is multiplied by one of its rows only, the same for most columns of a group, which is linear in
   the matrix and joins a large group of near copies at once without meeting them in pairs.
5. Then the columns that still hold several components are multiplied: all rows but those of the column's largest
   component against all rows, in blocks and by bands of set sizes, so that rows whose sizes exclude a link don't meet.
   Overlap counts are summed for each pair, and pairs below the bound for their sizes dropped.
6. What is left of 4 and 5 is checked on the whole rows of the matrix, and components are formed from the links.

Shingles are compared by 64-bit hashes; two different ones of a pair of documents with n shingles each share one with a chance of
about n * n / 2^64, some 10^-12 for documents of 5,000 words.

Null or empty texts have no shingles and link with nothing. Rows without an id take no part. Rows that repeat an id are
one node of the link graph, with the links of all their texts: each gets the same component, and its own text's set size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.graph import components, cut
from tarnfield.llm.textkit import LOWER, SPACES, chain, chunked, find_words, fresh_names, prefix_sums, span_hash, text_bytes

#: Shingles that one range of the hash space holds on average, and those of one chunk of documents.
_RANGE, _CHUNK = 1 << 21, 1 << 19
#: Owner of a shingle that several documents of its chunk hold; a chunk has fewer documents than that.
_SEVERAL = 0xFFFF
#: Ids that are sent to every task rather than joined by a shuffle: some 20 MB.
_FEW_IDS = 1_000_000
#: Rows that one task compares with the same row of the matrix, or multiplies in one block.
_BLOCK = 512
#: Columns of so many rows are multiplied before all others.
_FEW_ROWS = 16
#: Partitions that the ranges are dealt to at most.
_MOST_PARTITIONS = 1 << 14
#: Set sizes within this factor are one band.
_BAND = 1.04

def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of ``size`` words."""
    data, bounds = text_bytes(column)
    for first, last in chunked(bounds):
        part = LOWER[data[bounds[first] : bounds[last]]]
        starts, ends, rows = find_words(part, bounds[first : last + 1] - bounds[first], ~SPACES)
        words = span_hash(prefix_sums(part), starts, ends)
        full = chain(*(words[i : len(words) - size + 1 + i] for i in range(size)), seed=size) if len(words) >= size else words[:0]
        for i in range(last - first):
            low, high = rows[i], rows[i + 1]
            if high - low >= size:
                yield np.unique(full[low : high - size + 1])
            elif high > low:
                yield chain(*(words[j : j + 1] for j in range(low, high)), seed=1000 + int(high - low))
            else:
                yield words[:0]


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _key(hashes: np.ndarray) -> bytes:
    """Sixteen bytes that name a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _keys(size: int):
    """Per document the name and the size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for hashes in shingle_sets(batch.column(1), size):
                keys.append(_key(hashes))
                sizes.append(len(hashes))
            names = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(sizes, pa.int64())], ["doc_id", "k1", "k2", "n"])

    return run


_SENT = "part int, chunk long, ids binary, sizes binary, rest binary, owners binary"
_TOLD = "chunk long, ids binary, sizes binary, owners binary, counts binary"


def _send(size: int, bits: int):
    """Chunks of documents, and their distinct shingles by range of the hash space.

    A chunk's own row has its ids, set sizes and how many shingles each shares inside the chunk. Its other rows have
    the 32 bits after the range's of each shingle, rising, and the document that holds it.
    """

    def rows(number: int, ids: list[int], sets: list[np.ndarray]) -> Iterator[tuple]:
        sizes = np.array([len(x) for x in sets], np.uint32)
        owner = np.repeat(np.arange(len(sets)), sizes)
        hashes = np.concatenate(sets)
        order = np.argsort(hashes)
        hashes, owner = hashes[order], owner[order]
        opens = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        lengths = np.diff(np.append(opens, len(hashes)))
        inside = np.bincount(owner[np.repeat(lengths > 1, lengths)], minlength=len(sets)).astype(np.uint32)
        hashes, owner = hashes[opens], np.where(lengths > 1, _SEVERAL, owner[opens]).astype(np.uint16)
        names = np.array(ids, np.int64).tobytes()
        chunk = int.from_bytes(hashlib.blake2b(names, digest_size=8, salt=number.to_bytes(8, "little")).digest(), "little", signed=True)
        yield chunk % (1 << bits), chunk, names, sizes.tobytes(), None, inside.tobytes()
        part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        rest = (hashes >> np.uint64(32 - bits)).astype(np.uint32)
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)).tolist()
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield int(part[low]), chunk, None, None, rest[low:high].tobytes(), owner[low:high].tobytes()

    def packed(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["part", "chunk", "ids", "sizes", "rest", "owners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        ids, sets, seen, held = [], [], set(), 0
        for batch in batches:
            for doc, hashes in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True):
                key = _key(hashes)
                if not len(hashes) or key in seen:
                    continue
                seen.add(key)
                ids.append(doc)
                sets.append(hashes)
                held += len(hashes)
                if held >= _CHUNK or len(ids) == _SEVERAL - 1:
                    yield packed(list(rows(number, ids, sets)))
                    number, ids, sets, seen, held = number + 1, [], [], set(), 0
        if ids:
            yield packed(list(rows(number, ids, sets)))

    return run


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range. For each chunk and range, how many shingles of a document other chunks hold too."""
    names = ["chunk", "ids", "sizes", "owners", "counts"]

    def told(chunks: list[int], rests: list[bytes], owners: list[bytes]) -> Iterator[pa.RecordBatch]:
        rest = np.frombuffer(b"".join(rests), np.uint32)
        place = np.frombuffer(b"".join(owners), np.uint16).astype(np.int64)
        place[place == _SEVERAL] = -1
        place = np.where(place < 0, -1, place + (np.repeat(np.arange(len(chunks)), [len(r) // 4 for r in rests]) << 16))
        order = np.argsort(rest)
        rest, place = rest[order], place[order]
        same = rest[1:] == rest[:-1]
        place = place[np.append(same, False) | np.append(False, same)]
        place, counts = np.unique(place[place >= 0], return_counts=True)
        cuts = np.searchsorted(place, np.arange(len(chunks) + 1) << 16).tolist()
        spans = [(c, low, high) for c, low, high in zip(chunks, cuts, cuts[1:], strict=False) if high > low]
        empty = pa.nulls(len(spans), pa.binary())
        yield pa.RecordBatch.from_arrays([
            pa.array([c for c, _, _ in spans], pa.int64()), empty, empty, pa.array([(place[a:b] & 0xFFFF).astype(np.uint16).tobytes() for _, a, b in spans], pa.binary()),
            pa.array([counts[a:b].astype(np.uint32).tobytes() for _, a, b in spans], pa.binary()),
        ], names)

    now, chunks, rests, owners = None, [], [], []
    for batch in batches:
        own = batch.filter(batch.column("ids").is_valid())
        yield pa.RecordBatch.from_arrays([own.column("chunk"), own.column("ids"), own.column("sizes"), pa.nulls(own.num_rows, pa.binary()), own.column("owners")], names)
        sent = batch.filter(batch.column("ids").is_null())
        for part, chunk, rest, owner in zip(*(sent.column(c).to_pylist() for c in ("part", "chunk", "rest", "owners")), strict=True):
            if part != now and chunks:
                yield from told(chunks, rests, owners)
                chunks, rests, owners = [], [], []
            now = part
            chunks.append(chunk)
            rests.append(rest)
            owners.append(owner)
    if chunks:
        yield from told(chunks, rests, owners)


def _decide(percent: int):
    """Rows sorted by chunk, its own row first. The ids whose shingles are shared to ``percent`` at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = sizes = shared = None

        def decided() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids[100 * shared >= percent * sizes])], ["doc_id"])

        for batch in batches:
            for names, n, owners, counts in zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "owners", "counts")), strict=True):
                found = np.frombuffer(counts, np.uint32).astype(np.int64)
                if names is None:
                    shared[np.frombuffer(owners, np.uint16)] += found
                    continue
                if ids is not None:
                    yield decided()
                ids, sizes, shared = np.frombuffer(names, np.int64), np.frombuffer(n, np.uint32).astype(np.int64), found.copy()
        if ids is not None:
            yield decided()

    return run


def linkable_ids(rows: DataFrame, shingles: int, size: int, percent: int) -> DataFrame:
    """The ids of all classes that may link: of each chunk's documents with the same set one stands for all.

    ``shingles`` is the sum of all set sizes. Hashes that agree in the bits sent count as shared, which only keeps more.
    """
    bits = min(24, max(4, math.ceil(math.log2(max(1, shingles / _RANGE)))))
    # A task goes through its ranges one after the other, so there may be more of them than Spark takes partitions.
    sent = rows.mapInArrow(_send(size, bits), _SENT).repartition(min(1 << bits, _MOST_PARTITIONS), "part").sortWithinPartitions("part")
    told = sent.mapInArrow(_tell, _TOLD).repartition("chunk").sortWithinPartitions("chunk", F.col("ids").isNull())
    return told.mapInArrow(_decide(percent), "doc_id long").distinct()


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(0), size))
            names = np.frombuffer(b"".join(map(_key, found)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["k1", "k2", "hashes"])

    return run


def _few(ids: DataFrame) -> DataFrame:
    """Marked to travel to every task if few by count."""
    return F.broadcast(ids) if ids.count() <= _FEW_IDS else ids


def matrix(rows: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """The rows of the incidence matrix: (c, n, hashes) for each class (c, k1, k2, n, rep)."""
    ids = cut(classes.select(F.col("rep").alias("doc_id")).distinct())
    found = rows.join(_few(ids), "doc_id", "left_semi").select("text").mapInArrow(_sets(size), "k1 long, k2 long, hashes array<long>")
    # A repeated row gives its set again, a repeated id another set.
    found = found.groupBy("k1", "k2").agg(F.first("hashes").alias("hashes"))
    return cut(found.join(classes.select("c", "k1", "k2", "n"), ["k1", "k2"]).select("c", "n", "hashes"))


def first_entries(sets: DataFrame, percent: int) -> DataFrame:
    """(sh, c, n, m, pos): the shared entries among each row's first, rare ones first, with the number ``m`` of shared ones.

    The shingles that a row shares with none come before the others, so they take up places.
    """
    entries = sets.select("c", "n", F.explode("hashes").alias("sh"))
    often = entries.groupBy("sh").agg(F.count("*").alias("often")).where("often > 1")
    order = Window.partitionBy("c").orderBy("often", "sh")
    shared = entries.join(often, "sh").withColumns({"r": F.row_number().over(order), "m": F.count("*").over(Window.partitionBy("c"))})
    shared = shared.where(100 * F.col("m") >= percent * F.col("n")).withColumn("pos", (F.col("n") - F.col("m") + F.col("r") - 1))
    return cut(shared.where(F.col("pos") < F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("sh", "c", "n", "m", "pos"))


def _links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both) > 0


def _compare(percent: int):
    """Rows (a, salt, b, hashes) sorted by block: the block's own row, where b is null, then those compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            lists = batch.column("hashes")
            values, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
            a, b = [], []
            for i, (one, two) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                hashes = values[bounds[i] : bounds[i + 1]]
                if two is None:
                    held = hashes
                elif _links(held, hashes, percent):
                    a.append(one)
                    b.append(two)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, from the whole rows of the matrix. Pairs of one ``a`` are dealt in blocks."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / _BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("salt"))
    heads = dealt.select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("c")).distinct()
    wanted = dealt.select("a", "salt", "b", F.col("b").alias("c")).unionByName(heads)
    blocks = wanted.join(sets.select("c", "hashes"), "c").select("a", "salt", "b", "hashes").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return blocks.mapInArrow(_compare(percent), "a long, b long")


def _enough(n1: Column, n2: Column, overlap: Column, percent: int) -> Column:
    return (100 + percent) * overlap >= percent * (n1 + n2)


def _possible(percent: int) -> Column:
    """Whether the places of a common shingle, and the shared entries of both rows, leave room for a link."""
    fits = F.least(F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")), "ma", "mb")
    return _enough(F.col("na"), F.col("nb"), fits, percent)


def _side(entries: DataFrame, side: str, *more: str) -> DataFrame:
    return entries.select("sh", *more, F.col("c").alias(side), *(F.col(x).alias(x[0] + side) for x in ("n", "m", "pos")))


def star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): each column's entries with its most central class, the one with the fewest shingles of its own.

    That is what the others of a group were copied from, if any is, and it is the same for many columns.
    """
    heads = entries.groupBy("sh").agg(F.min(F.struct((F.col("n") - F.col("m")).alias("own"), "c", "n", "m", "pos")).alias("h"), F.count("*").alias("rows")).where("rows > 1").select("sh", "h.*")
    return _side(heads, "a").join(_side(entries, "b"), "sh").where("a <> b").where(_possible(percent)).select("a", "b").distinct()


def product_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components whose summed overlap leaves room for a link. ``entries`` have a ``component``.

    A row of size n with m shared entries meets sizes from ``percent`` of n to what m allows. The larger row of a pair, or
    of equals the later class, is the one that looks for the other, so each pair meets once a column, and a row whose m
    allows no size as large as its own isn't there to be found. Of rows that must share o shingles the first common one
    lies among the first n - o + 1 of each, so the places that count depend on the sizes looked for.
    """
    by_component = entries.groupBy("sh", "component").agg(F.count("*").alias("rows"))
    column = by_component.groupBy("sh").agg(F.max_by("component", "rows").alias("largest"), F.sum("rows").alias("rows"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    inside = cut(entries.join(column, "sh"))
    band = lambda n: F.floor(F.log(n) / math.log(_BAND)).cast("int")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / _BLOCK)).cast("int")
    allowed = F.floor(F.col("m") * (100 + percent) / percent) - F.col("n")
    least, most = F.ceil(F.col("n") * percent / 100), F.least("n", allowed)
    must = lambda n1, n2: F.ceil((n1 + n2) * percent / (100 + percent))
    looks = inside.where(most >= least).withColumns({"band": F.explode(F.sequence(band(least) - 1, band(most) + 1))})
    smallest = F.greatest(F.floor(F.pow(F.lit(_BAND), F.col("band"))) - 1, least)
    looks = looks.withColumn("past", must(F.col("n"), smallest) - 1).where(F.col("pos") < F.col("n") - F.col("past"))
    # The looking row goes to each block of its column; the rows that are found lie in one block each.
    looks = looks.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    found = inside.where(allowed >= F.col("n")).withColumn("past", must(F.col("n"), F.col("n")) - 1).where(F.col("pos") < F.col("n") - F.col("past")).withColumn("band", band(F.col("n"))).withColumn("block", F.pmod(F.xxhash64("c"), blocks).cast("int"))
    keys, minor = ["band", "block"], F.col("component") != F.col("largest")
    later = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))

    def met(one: DataFrame, two: DataFrame) -> DataFrame:
        left, right = _side(one, "a", *keys, F.col("component").alias("ca"), F.col("past").alias("la")), _side(two, "b", *keys, F.col("component").alias("cb"), F.col("past").alias("lb"))
        return left.join(right, ["sh", *keys]).where((F.col("ca") != F.col("cb")) & later & _possible(percent))

    product = met(looks.where(minor), found).unionByName(met(looks.where(~minor), found.where(minor)))
    # What is common and not counted lies past the places that count in one of the two.
    overlap = product.groupBy("a", "b", "na", "nb", "ma", "mb").agg(F.count("*").alias("overlap"), F.max(F.greatest("la", "lb")).alias("past"))
    bound = F.least(F.col("overlap") + F.col("past"), "ma", "mb")
    return overlap.where(_enough(F.col("na"), F.col("nb"), bound, percent)).select("a", "b")


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """Per row of ``docs`` with an id: doc_id, n_shingles and component_id, the smallest id reachable by links."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = cut(rows.mapInArrow(_keys(size), "doc_id long, k1 long, k2 long, n long"))
    shingles = keyed.agg(F.sum("n")).first()[0] or 0
    classes = keyed.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    some = keyed.where("n > 0").join(linkable_ids(rows, shingles, size, percent), "doc_id", "left_semi").select("k1", "k2").distinct()
    # The checkpoint fixes the numbers c.
    numbered = cut(classes.join(some, ["k1", "k2"]).withColumn("c", F.monotonically_increasing_id()))
    sets = matrix(rows, numbered, size)
    entries = first_entries(sets, percent)
    both_ways = lambda pairs: pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows_of = entries.groupBy("sh").agg(F.count("*").alias("rows"))
    # Overlaps in few-row columns only: a pair that falls short of the bound here is met again below.
    few = entries.join(rows_of.where(F.col("rows").between(2, _FEW_ROWS)).select("sh"), "sh").withColumn("component", F.col("c"))
    direct = cut(product_pairs(few, percent))
    many = entries.join(rows_of.where(F.col("rows") > _FEW_ROWS).select("sh"), "sh")
    stars = cut(star_pairs(many, percent).join(both_ways(direct), ["a", "b"], "left_anti"))
    tried = direct.unionByName(stars)
    links = cut(_verified(tried, sets, percent))
    joined = components(links).withColumnRenamed("node", "c")
    labelled = entries.join(joined, "c", "left").withColumn("component", F.coalesce("component", "c"))
    more = cut(product_pairs(labelled, percent).join(both_ways(tried), ["a", "b"], "left_anti"))
    links = links.unionByName(_verified(more, sets, percent))
    # From classes to ids: the smallest id of a class stands for it, and an id with several texts joins their classes.
    named = numbered.select("c", "rep")
    edges = links.join(named.toDF("a", "one"), "a").join(named.toDF("b", "two"), "b").select(F.col("one").alias("a"), F.col("two").alias("b"))
    several = keyed.groupBy("doc_id").agg(F.min("k1").alias("l1"), F.max("k1").alias("h1"), F.min("k2").alias("l2"), F.max("k2").alias("h2")).where("l1 <> h1 or l2 <> h2").select("doc_id")
    again = keyed.where("n > 0").join(several, "doc_id", "left_semi").distinct().join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    joined = components(edges.unionByName(again)).withColumnRenamed("node", "rep")
    named = classes.join(joined, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    # An id whose only other texts are empty keeps its links on those rows too.
    own = joined.join(several, F.col("rep") == F.col("doc_id"), "left_semi").select(F.col("rep").alias("doc_id"), F.col("component").alias("own"))
    out = keyed.join(named, ["k1", "k2"], "left").join(own, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("own", "component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """The rows, with all their columns, whose id is the smallest of its component, and all without an id.

    Of rows that repeat an id and a text one stays, the first by the hash of all its columns.
    """
    names = jaccard_classes(docs, doc_id, text, size, percent)
    key, again, whole = fresh_names(docs.columns, "id", "again", "row")
    first = names.where("doc_id = component_id").groupBy(F.col("doc_id").alias(key)).agg((F.count("*") > 1).alias(again))
    kept = docs.join(first, F.col(f"`{doc_id}`").cast("long") == F.col(key)).drop(key)
    alone = kept.where(~F.col(again)).drop(again)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = kept.where(again).groupBy(F.col(f"`{doc_id}`").alias(key), F.col(f"`{text}`").alias(again)).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(whole))
    return alone.unionByName(repeated.select(f"{whole}.*")).unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
