"""Lexical search over pages: feature sets, postings, coverage scores and evidence.

A page scores 0.5 for the share of the query's words that it holds, 0.3 for Hangul bigrams and 0.2 for trigrams; a kind
that the query lacks drops out of the sum of weights, but words always count. Each share is rounded to six decimals and
so is the score. Results are ordered by score and then page id, and ranked from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.text import feature_sets, hangul_grams, page_id_like, prefixed_sha256, round6, safe_reference, safe_text, tokens

KINDS = ("word", "bigram", "trigram")
FIELDS = ("title", "summary", "body")
#: The weight of each kind.
WEIGHTS = {"word": 0.5, "bigram": 0.3, "trigram": 0.2}
#: Repeated page ids that ``posting_sizes`` sends to every task at most.
MAX_REPEATED = 100_000
#: Parts that ``batch_search`` makes of the pages that one task reads.
PARTS = 16


def weighted_score(coverage: dict[str, Column]) -> Column:
    """The score from the three shares; null is a kind that the query lacks."""
    word = F.coalesce(coverage["word"], F.lit(0.0))
    top = F.lit(0.5) * word + F.coalesce(F.lit(0.3) * coverage["bigram"], F.lit(0.0)) + F.coalesce(F.lit(0.2) * coverage["trigram"], F.lit(0.0))
    bottom = F.lit(0.5) + F.when(coverage["bigram"].isNotNull(), 0.3).otherwise(0.0) + F.when(coverage["trigram"].isNotNull(), 0.2).otherwise(0.0)
    return round6(top / bottom)


def share(matches: Column, wanted: Column) -> Column:
    return F.when(wanted > 0, round6(matches / wanted.cast("double")))


def query_features(spark, text: str) -> dict[str, list[str]]:
    """The distinct features of one query, worked out once."""
    row = spark.range(1).select(feature_sets(F.lit(text), normalized=False).alias("f")).first()["f"]
    return {k: list(row[k]) for k in KINDS}


def scores(pages: DataFrame, query: str, page_id: str = "page_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Pages that score above 0 for one query: page_id, score, word, bigram, trigram, in no order. One scan and a projection."""
    wanted = query_features(pages.sparkSession, query)
    whole = F.array_distinct(F.flatten(F.array(*(tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields))))
    found = pages.select(F.col(page_id).alias("page_id"), whole.alias("_words"))
    sets = {"word": F.col("_words"), "bigram": hangul_grams(F.col("_words"), 2), "trigram": hangul_grams(F.col("_words"), 3)}
    coverage = {k: share(F.size(F.array_intersect(sets[k], F.array(*map(F.lit, wanted[k])))), F.lit(len(wanted[k]))) if wanted[k] else F.lit(None).cast("double") for k in KINDS}
    scored = found.select("page_id", *(coverage[k].alias(k) for k in KINDS))
    return scored.select("page_id", weighted_score({k: F.col(k) for k in KINDS}).alias("score"), *KINDS).where("score > 0")


def search(pages: DataFrame, query: str, page_id: str = "page_id", fields: tuple[str, ...] = FIELDS, limit: int = 20) -> DataFrame:
    """Ranked pages for one query: rank, page_id, score, word, bigram, trigram. Pages that score 0 are left out.

    The query's features are literals, so this is one scan, a projection and a top-k, without a join. Rank is worked
    out after the cut, on ``limit`` rows.
    """
    order = [F.desc("score"), F.asc("page_id")]
    best = scores(pages, query, page_id, fields).orderBy(*order).limit(limit)
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "page_id", "score", *KINDS)


def postings(pages: DataFrame, page_id: str = "page_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, kind, feature, page_id), one row each, with no page gathered whole anywhere."""
    rows = None
    for field in fields:
        own = pages.select(F.col(page_id).alias("page_id"), feature_sets(F.coalesce(F.col(field), F.lit(""))).alias("f"))
        for kind in KINDS:
            part = own.select(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.explode(f"f.{kind}").alias("feature"), "page_id")
            rows = part if rows is None else rows.unionByName(part)
    return rows


def posting_sizes(pages: DataFrame, page_id: str = "page_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Of each posting list: its number of pages and its smallest and largest page id.

    A page id that one row has needs no distinct count, so those lists are summed up where the pages lie. Rows that share
    an id go through distinct postings: up to ``MAX_REPEATED`` such ids are told apart by a broadcast, else all rows do.
    """
    lists = lambda rows: postings(rows, page_id, fields)
    sizes = lambda rows, n: rows.groupBy("field", "kind", "feature").agg(n.alias("n_pages"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"))
    repeated = pages.groupBy(page_id).agg(F.count("*").alias("n")).where(F.col(page_id).isNotNull() & (F.col("n") > 1)).select(page_id)
    n_repeated = repeated.limit(MAX_REPEATED + 1).count()
    if n_repeated > MAX_REPEATED:
        return sizes(lists(pages), F.count_distinct("page_id"))
    if n_repeated == 0:
        return sizes(lists(pages), F.count("page_id"))
    alone, shared = (pages.join(F.broadcast(repeated), page_id, how) for how in ("left_anti", "left_semi"))
    parts = sizes(lists(alone), F.count("page_id")).unionByName(sizes(lists(shared).distinct(), F.count("page_id")))
    return parts.groupBy("field", "kind", "feature").agg(F.sum("n_pages").alias("n_pages"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"))


def batch_search(pages: DataFrame, queries: DataFrame, page_id: str = "page_id", text: str = "text", query_id: str = "query_id", query_text: str = "query_text", limit: int = 20) -> DataFrame:
    """Word coverage of many queries at once: an equi-join on features instead of a product of queries and pages.

    Every row of a page is counted and ranked in one task, which takes ``1 / PARTS`` of what a task of the input reads, so its
    pairs of query and page don't grow with the table; only the best ``limit`` a query of each task go on.
    """
    wanted = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(tokens(F.coalesce(F.col(query_text), F.lit("")))).alias("w"))
    wanted = wanted.select("query_id", F.size("w").alias("n"), F.explode("w").alias("feature"))
    words = pages.select(F.col(page_id).alias("page_id"), F.array_distinct(tokens(F.coalesce(F.col(text), F.lit("")))).alias("w"))
    held = words.repartition(PARTS * max(1, pages.rdd.getNumPartitions()), "page_id").select("page_id", F.explode("w").alias("feature"))
    matched = held.join(wanted, "feature").groupBy("query_id", "page_id", "n").agg(F.count("*").alias("matches"))
    scored = matched.select("query_id", "page_id", "matches", share(F.col("matches"), F.col("n")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def evidence(pages: DataFrame, query: str, page_id: str = "page_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(page_id, kind, field, matches) for each kind and field with a match."""
    wanted = query_features(pages.sparkSession, query)
    sets = {f: feature_sets(F.coalesce(F.col(f), F.lit(""))) for f in fields}
    cells = [F.struct(F.lit(k).alias("kind"), F.lit(f).alias("field"), F.size(F.array_intersect(sets[f][k], F.array(*map(F.lit, wanted[k])))).alias("matches")) for k in KINDS if wanted[k] for f in fields]
    if not cells:
        cells = [F.struct(F.lit("word").alias("kind"), F.lit(fields[0]).alias("field"), F.lit(0).alias("matches"))]
    rows = pages.select(F.col(page_id).alias("page_id"), F.explode(F.array(*cells)).alias("c"))
    return rows.select("page_id", "c.kind", "c.field", "c.matches").where("matches > 0")


def validated_pages(pages: DataFrame) -> DataFrame:
    """The pages with sorted references and a ``problem``: null, or what is wrong with the row."""
    refs = F.coalesce(F.col("source_refs"), F.array().cast("array<string>"))
    copies = Window.partitionBy("page_id")
    problem = (
        F.when(~page_id_like(F.col("page_id")), "page-id")
        .when(F.count("*").over(copies) > 1, "duplicate-page")
        .when(~safe_text(F.col("title"), 500), "title")
        .when(~safe_text(F.col("body"), 1 << 20, lines=True), "body")
        .when((F.size(refs) < 1) | (F.size(refs) > 100) | (F.size(F.array_distinct(refs)) != F.size(refs)), "source-refs")
        .when(~F.forall(refs, lambda r: safe_reference(r)), "source-ref")
    )
    return pages.withColumns({"source_refs": F.sort_array(refs), "problem": problem})


def corpus_digest(pages: DataFrame, columns: list[str]) -> DataFrame:
    """One row that names the corpus whatever its order: a digest of bucket digests, each over its rows' digests.

    A bucket, of 4,096, gathers the digests of rows with the same first three digits, never their texts.
    """
    own = pages.select(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("d"))
    # Repeated rows stay one entry with its number.
    counted = own.groupBy("d").agg(F.count("*").alias("n"))
    parts = counted.groupBy(F.substring("d", 1, 3).alias("b")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "d", "n"))), ""), 256).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pages"), prefixed_sha256(joined).alias("digest"))
