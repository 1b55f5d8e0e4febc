"""Context results: for each query the pages and chunks that fit its budget, and the gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.text import utf16_length

#: Characters that count as one token.
TOKEN_CHARS = 4


def context_results(requests: DataFrame, ranked: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, page_id, rank, score, gap, chunks, page_tokens, requested_tokens, estimated_tokens, truncated), a row for each chosen page.

    ``requests``: query_id, budget, top_pages, top_chunks. ``ranked``: query_id, page_id, rank, score. ``pages``: page_id,
    summary. ``chunks``: page_id, chunk (from 1), text. The first ``top_pages`` pages are chosen. Their summaries and chunks, in
    the order of ranks and then chunks, no more chunks than ``top_chunks`` in all, are taken while the running sum of tokens
    stays within the budget; the first that doesn't fit ends it. ``gap`` says what a chosen page lacks: page-missing,
    over-budget (not even its summary), no-chunks (chunks were asked for, and it has none), or null. A query's window holds its
    chosen pages with ``top_chunks`` chunks each, whatever the pages' sizes.
    """
    chosen = ranked.join(requests, "query_id").where(F.col("rank") <= F.col("top_pages"))
    known = chosen.join(pages.select("page_id", F.col("summary"), F.lit(True).alias("_there")), "page_id", "left")
    tokens = lambda c: F.ceil(utf16_length(F.coalesce(c, F.lit(""))) / TOKEN_CHARS).cast("long")
    keys = ["query_id", "page_id", "rank", "budget", "top_chunks"]
    heads = known.where("_there").select(*keys, F.lit(0).alias("chunk"), tokens(F.col("summary")).alias("tokens"))
    most = requests.agg(F.max("top_chunks")).first()[0] or 0
    parts = chunks.where(F.col("chunk") <= most).select("page_id", "chunk", tokens(F.col("text")).alias("tokens"))
    own = known.where("_there").select(*keys).join(parts, "page_id").where(F.col("chunk") <= F.col("top_chunks")).select(*keys, "chunk", "tokens")
    order = Window.partitionBy("query_id").orderBy("rank", "page_id", "chunk")
    own = own.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("top_chunks")).drop("_n")
    units = heads.unionByName(own).withColumn("_sum", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Token counts aren't negative, so once the sum is past the budget it stays there.
    units = units.withColumn("_in", F.col("_sum") <= F.col("budget"))
    taken = units.groupBy("query_id", "page_id").agg(F.bool_or(F.col("_in") & (F.col("chunk") == 0)).alias("_head"), F.count_if(F.col("_in") & (F.col("chunk") > 0)).alias("chunks"), F.sum(F.when(F.col("_in"), F.col("tokens")).otherwise(0)).alias("page_tokens"))
    totals = units.groupBy("query_id").agg(F.sum(F.when(F.col("_in"), F.col("tokens")).otherwise(0)).alias("estimated_tokens"), F.bool_or(~F.col("_in")).alias("truncated"))
    some = known.join(chunks.select("page_id").distinct().withColumn("_some", F.lit(True)), "page_id", "left")
    rows = some.join(taken, ["query_id", "page_id"], "left").join(totals, "query_id", "left")
    gap = F.when(F.col("_there").isNull(), "page-missing").when(~F.coalesce("_head", F.lit(False)), "over-budget").when((F.col("top_chunks") > 0) & F.col("_some").isNull(), "no-chunks")
    zero = F.lit(0).cast("long")
    return rows.select(
        "query_id", "page_id", "rank", "score", gap.alias("gap"), F.coalesce("chunks", zero).alias("chunks"), F.coalesce("page_tokens", zero).alias("page_tokens"),
        F.col("budget").cast("long").alias("requested_tokens"), F.coalesce("estimated_tokens", zero).alias("estimated_tokens"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )
