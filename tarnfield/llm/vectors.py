"""Approximate nearest neighbours by largest inner product, through an inverted multi-index.

Both halves of the vectors are quantised by code books of their own, learned on a bounded sample; a vector's cell is its
pair of codes. There are about a quarter as many cells as vectors, up to ``most_codes`` codes a half. A query walks the
pairs in falling order of the summed inner products of its halves with the centroids (rising order of their negated sum,
the distance here), with a heap, until the cells seen hold its share of all vectors, and every entry of those cells is
scored exactly in double precision. The share is measured: for a sample of the queries the exact neighbours among all
entries are found, and the share is the least that would have found ``recall`` of them. So vectors in clusters are searched
in a few hundredths of the table, and vectors without any structure, where no index helps, in a third of it.

Cells only choose candidates, so scores and the order of results are exact. Entries go only to the blocks of queries that
look into their band of cells.

Equal vectors are one entry with the smallest ids that any query could need, and equal queries are searched once, so a
vector that fills a third of the table costs no more than another. Vectors that are null, zero, of another length than
most, or hold null or non-finite components take no part, neither as queries nor as entries. Rows that repeat an id
with the same vector count once; an id with several vectors is several entries, none of them a neighbour of its own id.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.graph import cut
from tarnfield.llm.textkit import bounded_sample

#: Entries and queries that meet in one task.
ENTRY_BLOCK, QUERY_BLOCK = 4096, 2048


class CodeBooks:
    """Centroids of both halves."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.half = first.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, codes: int, rounds: int = 12, seed: int = 5) -> CodeBooks:
        half = sample.shape[1] // 2
        rng = np.random.default_rng(seed)

        def centroids(x: np.ndarray) -> np.ndarray:
            x = np.unique(x, axis=0)
            c = x[rng.permutation(len(x))[: min(codes, len(x))]].copy()
            for _ in range(rounds):
                near = nearest(x, c)
                for k in range(len(c)):
                    own = x[near == k]
                    if len(own):
                        c[k] = own.mean(axis=0)
            return c

        return cls(centroids(sample[:, :half]), centroids(sample[:, half:]))

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.first) * len(self.second) + nearest(x[:, self.half :], self.second)

    def walk(self, query: np.ndarray, held: np.ndarray, wanted: float) -> np.ndarray:
        """A mask of the cells to look into: best pairs first until they hold ``wanted`` entries."""
        one, two = self.first @ query[: self.half], self.second @ query[self.half :]
        i_of, j_of = np.argsort(-one, kind="stable").tolist(), np.argsort(-two, kind="stable").tolist()
        u, v = (-one[i_of]).tolist(), (-two[j_of]).tolist()
        width = len(v)
        chosen = np.zeros(len(held), bool)
        heap, got = [(u[0] + v[0], 0, 0)], 0
        while heap and got < wanted:
            _, i, j = heapq.heappop(heap)
            cell = i_of[i] * width + j_of[j]
            if held[cell]:
                chosen[cell] = True
                got += held[cell]
            # Each pair enters once: along a row, and down the first column.
            if j + 1 < width:
                heapq.heappush(heap, (u[i] + v[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(u):
                heapq.heappush(heap, (u[i + 1] + v[0], i + 1, 0))
        return chosen

    def depth(self, query: np.ndarray, held: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many entries the walk has seen when it has been to each of the cells."""
        sums = np.add.outer(self.first @ query[: self.half], self.second @ query[self.half :]).reshape(-1)
        order = np.argsort(-sums, kind="stable")
        seen = np.empty(len(order), np.int64)
        seen[order] = np.cumsum(held[order])
        return seen[cells]


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def usable(vector: Column, length: int | None = None) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    out = vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(out if length is None else out & (F.size(vector) == length), F.lit(False))


def _best_entries(queries: np.ndarray, k: int):
    """The exact ``k`` best entries of each query among a task's (v, cell), without its own vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, cells = np.full((len(queries), 0), -np.inf), np.zeros((len(queries), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            found = queries @ x.T
            for i, query in enumerate(queries):
                found[i, (x == query).all(axis=1)] = -np.inf
            own = np.broadcast_to(batch.column(1).to_numpy(), found.shape)
            scores, cells = np.concatenate((scores, found), axis=1), np.concatenate((cells, own), axis=1)
            if scores.shape[1] > k:
                at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                scores, cells = np.take_along_axis(scores, at, axis=1), np.take_along_axis(cells, at, axis=1)
        i, j = np.nonzero(scores > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(scores[i, j]), pa.array(cells[i, j], pa.int32())], ["i", "score", "cell"])

    return run


def measured_share(entries: DataFrame, books: CodeBooks, held: np.ndarray, k: int, recall: float, sample_queries: int) -> float:
    """The least share of the entries that finds ``recall`` of the true neighbours of at most ``sample_queries`` queries."""
    sample = np.array([r["v"] for r in bounded_sample(entries.where("asked"), "e", sample_queries).select("v").collect()])
    if not len(sample):
        return 0.0
    best = Window.partitionBy("i").orderBy(F.desc("score"), "cell")
    found = entries.select("v", "cell").mapInArrow(_best_entries(sample, k), "i int, score double, cell int").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    true: dict[int, list[int]] = {}
    for r in found.select("i", "cell").collect():
        true.setdefault(r["i"], []).append(r["cell"])
    depths = [books.depth(sample[i], held, np.array(cells)) for i, cells in sorted(true.items())]
    return float(np.quantile(np.concatenate(depths), recall, method="higher")) / held.sum() if depths else 0.0


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    most_codes: int = 512, recall: float = 0.94, sample_rows: int = 20_000, sample_queries: int = 128,
) -> DataFrame:
    """Per query row its ``k`` best other rows: query_id, rank from 1, vec_id, score. Ties go to the smaller id.

    The code books are learned on at most ``sample_rows`` vectors and the share on at most ``sample_queries`` queries;
    every usable row is indexed. Books and cell counts that tasks get are bounded by ``most_codes``: some 2 MB at 512.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("v"), is_query.alias("q"))
    first = rows.where(usable(F.col("v")) & (F.size("v") >= 2)).select(F.size("v").alias("n")).groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if first is None:
        return empty
    length = int(first["n"])
    rows = rows.where(usable(F.col("v"), length))
    order = Window.partitionBy("v").orderBy("vec_id")
    ids = rows.select("v", "vec_id").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    asked = rows.where("q").select("v", F.lit(True).alias("asked")).distinct()
    entries = ids.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).join(asked, "v", "left")
    # The checkpoint fixes the numbers e.
    entries = cut(entries.select(F.monotonically_increasing_id().alias("e"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")))
    total = entries.count()
    codes = int(min(most_codes, max(8, math.isqrt(total) // 2)))
    picked = bounded_sample(entries, "v", sample_rows).select("v").collect()
    books = CodeBooks.fit(np.array([r["v"] for r in picked]), codes)
    shared = spark.sparkContext.broadcast(books)

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.cells(np.array(v.tolist())) if len(v) else [], dtype="int32")

    entries = cut(entries.withColumn("cell", cell_of("v")))
    # At most most_codes squared rows, whatever the table's size.
    held, questions = (np.zeros(len(books.first) * len(books.second), np.int64) for _ in range(2))
    for r in entries.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).collect():
        held[r["cell"]], questions[r["cell"]] = r["n"], r["asked"]
    share = measured_share(entries, books, held, k, recall, sample_queries)
    wanted = min(total, max(math.ceil(share * total), k + 1))
    counts = spark.sparkContext.broadcast(held)
    second = len(books.second)

    def grouped(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring first codes in groups of about ``most`` rows, and into how many parts each group is dealt."""
        of, load, group = np.zeros(len(sizes), np.int64), 0, 0
        for i, n in enumerate(sizes):
            if load and load + n > most:
                group, load = group + 1, 0
            of[i], load = group, load + n
        return of, np.maximum(1, -(-np.bincount(of, sizes).astype(np.int64) // most))

    band_of, chunks = grouped(held.reshape(-1, second).sum(axis=1), ENTRY_BLOCK)
    block_of, parts = grouped(questions.reshape(-1, second).sum(axis=1), QUERY_BLOCK)
    lows = np.searchsorted(band_of, np.arange(len(chunks) + 1)) * second

    @F.pandas_udf("array<struct<band:int,cells:binary>>")
    def probes(v: pd.Series) -> pd.Series:
        out = []
        for query in v:
            mask = shared.value.walk(np.asarray(query), counts.value, wanted)
            out.append([{"band": b, "cells": np.packbits(part).tobytes()} for b, (low, high) in enumerate(zip(lows, lows[1:], strict=False)) if (part := mask[low:high]).any()])
        return pd.Series(out)

    lookup = lambda values, at: F.element_at(F.array(*(F.lit(int(x)) for x in values)), at.cast("int") + 1)
    code = F.floor(F.col("cell") / second)
    dealt = lambda key, n, seed: F.pmod(F.xxhash64(key, F.lit(seed)), n).cast("int")
    queries = entries.where("asked").withColumn("block", lookup(block_of, code))
    queries = queries.withColumn("part", dealt("e", lookup(parts, F.col("block")), 2)).select("e", "v", "block", "part")
    # Dealt by number, so that walks don't end up in one task.
    queries = queries.repartition(max(8, int(questions.sum()) // 256), "e").select("e", "block", "part", "v", F.explode(probes("v")).alias("p"))
    right = cut(queries.select("e", "v", "block", "part", "p.band", "p.cells"))
    meets = right.select("band", "block", "part").distinct()
    left = entries.withColumn("band", lookup(band_of, code)).withColumn("chunk", dealt("e", lookup(chunks, F.col("band")), 1)).select("band", "chunk", F.col("v").alias("x"), "ids", "cell").join(meets, "band")
    right = right.select("e", F.col("v").alias("v"), *(F.col(c).alias(c) for c in ("band", "block", "part", "cells"))).withColumn("chunk", F.explode(F.sequence(F.lit(0), lookup(chunks, F.col("band")).cast("int") - 1)))

    def score(key, found: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(queries):
            return pd.DataFrame({"q": [], "ids": [], "score": []})
        x, q = np.array(found["x"].tolist()), np.array(queries["v"].tolist())
        at = found["cell"].to_numpy() - lows[key[0]]
        names, keys, scores = found["ids"].to_numpy(), [], []
        best_ids = []
        for query, name, cells in zip(q, queries["e"].tolist(), queries["cells"], strict=True):
            inside = np.flatnonzero(np.unpackbits(np.frombuffer(cells, np.uint8))[at])
            if not len(inside):
                continue
            near = x[inside] @ query
            if len(inside) > k + 1:
                # Of tied entries all stay.
                least = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
                inside, near = inside[near >= least], near[near >= least]
            keys += [name] * len(inside)
            best_ids += names[inside].tolist()
            scores += near.tolist()
        return pd.DataFrame({"q": keys, "ids": best_ids, "score": scores})

    grid = ["band", "chunk", "block", "part"]
    found = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(score, "q long, ids array<long>, score double")
    close = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = found.select("q", F.explode("ids").alias("vec_id"), "score").groupBy("q", "vec_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(close)).where(F.col("r") <= k + 1)
    best = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    # Back to every query row: its own id leaves the list, the rest moves up.
    own = rows.where("q").select("v", F.col("vec_id").alias("query_id")).distinct().join(entries.where("asked").select("v", F.col("e").alias("q")), "v").drop("v")
    lists = own.join(best, "q").select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return lists.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def neighbours_query(vectors: DataFrame) -> DataFrame:
    return nearest_neighbours(vectors, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))
