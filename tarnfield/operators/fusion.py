"""Semantic ranks and their fusion with lexical ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.text import round6


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def semantic_scores(vectors: DataFrame, query: list[float], vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(page_id, score) by cosine with the query vector, in no order; vectors without a cosine are left out."""
    scored = vectors.select(F.col(vec_id).alias("page_id"), cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query))).alias("score"))
    return scored.where("score is not null")


def semantic_ranks(vectors: DataFrame, query: list[float], vec_id: str = "vec_id", vector: str = "embedding", limit: int = 20) -> DataFrame:
    """(page_id, rank) of the ``limit`` best by falling cosine with the query vector, then id: a top-k without a global sort."""
    order = [F.desc("score"), F.asc("page_id")]
    best = semantic_scores(vectors, query, vec_id, vector).orderBy(*order).limit(limit)
    return best.select("page_id", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def first_places(rankings: DataFrame, query_id: str = "query_id", page_ids: str = "page_ids") -> DataFrame:
    """(query_id, page_id, rank) of listed results; a page listed twice keeps its first place and later ones move up."""
    listed = rankings.select(F.col(query_id).alias("query_id"), F.posexplode(page_ids).alias("at", "page_id"))
    first = listed.groupBy("query_id", "page_id").agg(F.min("at").alias("at"))
    return first.select("query_id", "page_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("rank"))


def missing_pages(ranks: DataFrame, pages: DataFrame) -> DataFrame:
    """Ranked page ids that the corpus lacks."""
    return ranks.join(pages.select("page_id"), "page_id", "left_anti").select("page_id").distinct()


def semantic_hits(ranks: DataFrame, limit: int = 20) -> DataFrame:
    return ranks.where(F.col("rank") <= limit).select("rank", "page_id", round6(F.lit(1.0) / F.col("rank")).alias("score"))


def fused(lexical: DataFrame, semantic: DataFrame, keys: tuple[str, ...] = (), limit: int | None = 20) -> DataFrame:
    """Half of 1/rank from each side, each rounded before the sum; by sum and then page id, ranked within ``keys``."""
    on = [*keys, "page_id"]
    both = lexical.select(*on, F.col("rank").alias("lexical_rank")).join(semantic.select(*on, F.col("rank").alias("semantic_rank")), on, "full")
    part = lambda c: F.coalesce(round6(F.lit(0.5) / F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", round6(part("lexical_rank") + part("semantic_rank")))
    order = [F.desc("score"), F.asc("page_id")]
    if not keys and limit is not None:
        scored = scored.orderBy(*order).limit(limit)
    window = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    ranked = scored.select(*keys, F.row_number().over(window).alias("rank"), "page_id", "score", "lexical_rank", "semantic_rank")
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def hybrid(lexical: DataFrame, semantic: DataFrame, limit: int = 20) -> DataFrame:
    """The fused top ``limit`` from the scores (page_id, score) of either side, without ranking either side whole.

    The first ``limit`` rows of one side alone have a sum of 0.5 / limit or more, so a row beyond twice that place on both
    sides can't be among the best. The heads of both sides give at most four times ``limit`` candidates; the place that one
    has on the side where it isn't in the head is 1 plus the number of rows before it, counted in one pass for all of them.
    """
    most, spark = 2 * limit, lexical.sparkSession
    order = [F.desc("score"), F.asc("page_id")]
    kind = lexical.schema["page_id"].dataType
    # Scores are worked out once and looked at three times.
    sides = {"lexical_rank": lexical.select("page_id", "score").persist(), "semantic_rank": semantic.select("page_id", "score").persist()}
    heads = {name: {r["page_id"]: i + 1 for i, r in enumerate(rows.orderBy(*order).limit(most).collect())} for name, rows in sides.items()}
    places = dict(heads)
    for (name, rows), other in zip(sides.items(), ("semantic_rank", "lexical_rank"), strict=True):
        late = [p for p in heads[other] if p not in heads[name]]
        own = rows.where(F.col("page_id").isin(late)).collect() if late else []
        if own:
            before = [F.count_if((F.col("score") > F.lit(r["score"])) | ((F.col("score") == F.lit(r["score"])) & (F.col("page_id") < F.lit(r["page_id"])))) for r in own]
            counted = rows.agg(*(n.alias(f"n{i}") for i, n in enumerate(before))).first()
            places[name] = heads[name] | {r["page_id"]: counted[i] + 1 for i, r in enumerate(own)}
    for rows in sides.values():
        rows.unpersist()
    found = [(p, places["lexical_rank"].get(p), places["semantic_rank"].get(p)) for p in sorted(set(heads["lexical_rank"]) | set(heads["semantic_rank"]))]
    candidates = spark.createDataFrame(found, f"page_id {kind.simpleString()}, lexical_rank int, semantic_rank int")
    left = candidates.where("lexical_rank is not null").select("page_id", F.col("lexical_rank").alias("rank"))
    return fused(left, candidates.where("semantic_rank is not null").select("page_id", F.col("semantic_rank").alias("rank")), limit=limit)


def search_mode(wanted: str, store: bool, provider: bool, index: str) -> tuple[str, str | None]:
    """The mode that can be served and why it fell back: no store, then no provider, then an index that isn't current."""
    if wanted == "lexical":
        return wanted, None
    if not store:
        return "lexical", "store-unavailable"
    if not provider:
        return "lexical", "provider-unconfigured"
    if index != "compatible":
        return "lexical", "index-outdated"
    return wanted, None
