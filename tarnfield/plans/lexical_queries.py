"""Search, postings, evidence, fusion and evaluation over ``documents``, ``embeddings`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.functions.text import hangul_grams, tokens
from tarnfield.operators import evaluate, fusion, index, lexical
from tarnfield.plans.tables import table

QUERY = "The tion of and with erin"


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(table(spark, sf_dir, "documents"), QUERY, "doc_id", ("text",))
    return found.select("rank", F.col("page_id").alias("doc_id"), "score")


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"
_ROUND = "floor(({}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"
_COVERAGE = _ROUND.format("len(list_intersect(d.w, q.w)) / len(q.w)::DOUBLE")
_SCORED = f"""
q AS (SELECT {_WORDS.format(f"'{QUERY}'")} AS w),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
c AS (SELECT d.doc_id, {_COVERAGE} AS word FROM d, q),
s AS (SELECT doc_id, {_ROUND.format("0.5::DOUBLE * word / 0.5::DOUBLE")} AS score FROM c WHERE word > 0)"""
LEXICAL_SQL = f"WITH {_SCORED} SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s ORDER BY rank LIMIT 20"


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


TOKENS_SQL = "SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents)"


def hangul_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with some of their letters spelled as Hangul, and how many documents hold each n-gram of their words."""
    text = F.translate(F.lower(F.coalesce("text", F.lit(""))), _LATIN, _HANGUL)
    rows = table(spark, sf_dir, "documents").select("doc_id", tokens(text).alias("w"))
    named = lambda n: lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"))
    grams = F.flatten(F.array(*(F.transform(hangul_grams(F.col("w"), n), named(n)) for n in (2, 3))))
    return rows.select("doc_id", F.explode(grams).alias("g")).groupBy("g.n", "g.gram").agg(F.count("*").alias("documents"))


_LATIN, _HANGUL = "aeiourstl", "가나다라마바사아자"
HANGUL_SQL = f"""
WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(translate(lower(coalesce(text, '')), '{_LATIN}', '{_HANGUL}'), '[\\p{{L}}\\p{{N}}]+'))) AS tok FROM documents),
r AS (SELECT doc_id, unnest(regexp_extract_all(tok, '[가-힣]+')) AS run FROM t),
g AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, length(run) - n + 2), lambda i: substr(run, i::INTEGER, n))) AS gram FROM r, (VALUES (2), (3)) v(n) WHERE length(run) >= n)
SELECT n, gram, count(*) AS documents FROM g GROUP BY ALL"""


def _split(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"), F.regexp_replace(text, r"\A[^\n]*\n?", "").alias("body"))


def field_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.evidence(_split(table(spark, sf_dir, "documents")), QUERY, "doc_id", ("title", "body"))
    return found.select(F.col("page_id").alias("doc_id"), "kind", "field", F.col("matches").cast("long").alias("matches"))


EVIDENCE_SQL = f"""
WITH q AS (SELECT {_WORDS.format(f"'{QUERY}'")} AS w),
f AS (SELECT doc_id, 'title' AS field, split_part(coalesce(text, ''), chr(10), 1) AS t FROM documents
      UNION ALL SELECT doc_id, 'body', regexp_replace(coalesce(text, ''), '^[^\\n]*\\n?', '') FROM documents)
SELECT doc_id, 'word' AS kind, field, len(list_intersect({_WORDS.format("t")}, q.w)) AS matches FROM f, q WHERE matches > 0"""


def postings_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.posting_sizes(table(spark, sf_dir, "documents"), "doc_id", ("text",)).where("kind = 'word'").select("feature", "n_pages", "first_page", "last_page")


POSTINGS_SQL = f"WITH t AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS feature FROM documents) SELECT feature, count(DISTINCT doc_id) AS n_pages, min(doc_id) AS first_page, max(doc_id) AS last_page FROM t GROUP BY feature"


def _batch(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    return lexical.batch_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", limit)


def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, 5).select("query_id", F.col("page_id").alias("doc_id"), "matches", "score", F.col("rank").cast("long").alias("rank"))


_BATCH = f"""
b AS (SELECT item_id AS query_id, {_WORDS.format("text")} AS w FROM benchmark),
bq AS (SELECT query_id, len(w) AS n, unnest(w) AS feature FROM b),
h AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS feature FROM documents),
m AS (SELECT query_id, doc_id, n, count(*) AS matches FROM h JOIN bq USING (feature) GROUP BY ALL),
bs AS (SELECT query_id, doc_id, matches, {_ROUND.format("matches / n::DOUBLE")} AS score FROM m),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs)"""
BATCH_SQL = f"WITH {_BATCH} SELECT query_id, doc_id, matches, score, rank FROM br WHERE rank <= 5"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row["embedding"]]


def semantic_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = fusion.semantic_ranks(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), limit=20)
    return fusion.semantic_hits(ranks).select(F.col("page_id").alias("vec_id"), "rank", "score")


_COSINE = "list_dot_product(e.embedding::DOUBLE[], v.q) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(v.q, v.q))"
_SEMANTIC = f"""
v AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
sr AS (SELECT e.vec_id, row_number() OVER (ORDER BY {_COSINE} DESC, e.vec_id)::INTEGER AS rank FROM embeddings e, v)"""
SEMANTIC_SQL = f"WITH {_SEMANTIC} SELECT vec_id, rank, {_ROUND.format('1.0::DOUBLE / rank')} AS score FROM sr WHERE rank <= 20"


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lexical.scores(table(spark, sf_dir, "documents"), QUERY, "doc_id", ("text",))
    meaning = fusion.semantic_scores(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir))
    return fusion.hybrid(words, meaning).select("rank", F.col("page_id").alias("doc_id"), "score", "lexical_rank", "semantic_rank")


HYBRID_SQL = f"""
WITH {_SCORED.lstrip()}, {_SEMANTIC.lstrip()},
l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS lexical_rank FROM s),
f AS (SELECT coalesce(l.doc_id, sr.vec_id) AS doc_id, lexical_rank, sr.rank AS semantic_rank FROM l FULL JOIN sr ON l.doc_id = sr.vec_id),
g AS (SELECT *, {_ROUND.format(f"coalesce({_ROUND.format('0.5::DOUBLE / lexical_rank')}, 0) + coalesce({_ROUND.format('0.5::DOUBLE / semantic_rank')}, 0)")} AS score FROM f)
SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score, lexical_rank, semantic_rank FROM g ORDER BY rank LIMIT 20"""


def _evaluation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rankings, relevant pages and queries: an item's relevant pages are those labelled good among five ids that follow from its own."""
    items = table(spark, sf_dir, "benchmark")
    category = F.element_at(F.array(*map(F.lit, evaluate.CATEGORIES)), (F.col("item_id") % 5 + 1).cast("int"))
    queries = items.select(F.col("item_id").alias("query_id"), category.alias("category"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("page_id"))
    wanted = items.select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    relevant = wanted.select("query_id", (F.col("query_id") * 13 + F.col("k")).alias("page_id")).join(good, "page_id", "left_semi").distinct()
    found = _batch(spark, sf_dir, 100).select("query_id", "page_id", "rank")
    back = found.select("query_id", "page_id", (F.lit(101) - F.col("rank")).alias("rank"))
    return found.select(F.lit("lexical").alias("mode"), "*").unionByName(back.select(F.lit("semantic").alias("mode"), "*")), relevant, queries


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(*_evaluation(spark, sf_dir), ("lexical", "semantic"))


_CATEGORY = "['korean-exact', 'korean-spacing-morphology', 'korean-synonym', 'korean-to-english', 'code-symbol-korean'][item_id % 5 + 1]"
_METRICS = f"""{_BATCH.lstrip()},
qs AS (SELECT item_id AS query_id, {_CATEGORY} AS category FROM benchmark),
rel AS (SELECT DISTINCT item_id AS query_id, l.doc_id FROM benchmark CROSS JOIN range(5) k(k) JOIN labels l ON l.doc_id = item_id * 13 + k.k WHERE l.quality = 1),
rk AS (SELECT 'lexical' AS mode, query_id, doc_id, rank FROM br WHERE rank <= 100 UNION ALL SELECT 'semantic', query_id, doc_id, 101 - rank FROM br WHERE rank <= 100),
hit AS (SELECT mode, query_id, count(*) FILTER (WHERE rank <= 5) AS hits, min(rank) AS first FROM rk JOIN rel USING (query_id, doc_id) GROUP BY ALL),
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL),
per AS (SELECT m.mode, qs.category, CASE WHEN n.n > 0 THEN coalesce(hits, 0) / n.n::DOUBLE ELSE 0 END AS r, coalesce(1.0::DOUBLE / first, 0) AS m
        FROM qs CROSS JOIN (SELECT DISTINCT mode FROM rk) m LEFT JOIN n USING (query_id) LEFT JOIN hit ON hit.mode = m.mode AND hit.query_id = qs.query_id),
mt AS (SELECT mode, category, count(*) AS query_count, {_ROUND.format("avg(r)")} AS recall_at_5, {_ROUND.format("avg(m)")} AS mrr FROM per GROUP BY ALL)"""
METRICS_SQL = f"WITH {_METRICS} SELECT * FROM mt"


def eval_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gated(eval_metrics(spark, sf_dir)).select("mode", "category", "minimum_mrr", "minimum_recall_at_5", "passed")


_GATES = "('lexical', 'korean-exact', 0.75::DOUBLE, 0.9::DOUBLE), ('semantic', 'korean-synonym', NULL, 0.8), ('semantic', 'korean-to-english', NULL, 0.7)"
GATES_SQL = f"WITH {_METRICS}, gt AS (SELECT * FROM (VALUES {_GATES}) v(mode, category, minimum_mrr, minimum_recall_at_5)) SELECT mode, category, minimum_mrr, minimum_recall_at_5, coalesce(mrr >= minimum_mrr, true) AND coalesce(recall_at_5 >= minimum_recall_at_5, true) AS passed FROM mt LEFT JOIN gt USING (mode, category)"


def eval_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The semantic metrics measured against the lexical ones as a baseline."""
    found = eval_metrics(spark, sf_dir)
    base = found.where("mode = 'lexical'").withColumn("mode", F.lit("m"))
    now = found.where("mode = 'semantic' and category <> 'korean-synonym'").withColumn("mode", F.lit("m"))
    return evaluate.regressions(now, base).select("category", "regressed")


REGRESSION_SQL = f"WITH {_METRICS} SELECT b.category, c.category IS NULL OR coalesce(c.recall_at_5 < b.recall_at_5, false) OR coalesce(c.mrr < b.mrr, false) AS regressed FROM (SELECT * FROM mt WHERE mode = 'lexical') b LEFT JOIN (SELECT * FROM mt WHERE mode = 'semantic' AND category <> 'korean-synonym') c USING (category)"


def candidate_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rankings, relevant, queries = _evaluation(spark, sf_dir)
    one = evaluate.hits_at(rankings.where("mode = 'lexical'").drop("mode"), relevant, queries, 20)
    two = evaluate.hits_at(rankings.where("mode = 'semantic'").drop("mode"), relevant, queries, 20)
    both = index.fused_rankings(*(rankings.where(F.col("mode") == m) for m in ("lexical", "semantic"))).select(F.lit("m").alias("mode"), "query_id", "page_id", "rank")
    base = rankings.where("mode = 'semantic'").withColumn("mode", F.lit("m"))
    return evaluate.candidate_comparison(one, two, evaluate.metrics(both, relevant, queries, ("m",)), evaluate.metrics(base, relevant, queries, ("m",)))


COMPARE_SQL = f"""
WITH {_METRICS},
h AS (SELECT qs.query_id, qs.category, bool_or(coalesce(rk.mode = 'lexical' AND rk.rank <= 20, false)) AS now, bool_or(coalesce(rk.mode = 'semantic' AND rk.rank <= 20, false)) AS before
      FROM qs LEFT JOIN (SELECT rk.* FROM rk JOIN rel USING (query_id, doc_id)) rk USING (query_id) GROUP BY ALL),
f AS (SELECT coalesce(bool_or(category = 'korean-spacing-morphology' AND now AND NOT before), false) AS gained,
             coalesce(bool_or(category = 'korean-spacing-morphology' AND NOT now AND before), false) AS lost,
             coalesce(bool_and(now) FILTER (WHERE category = 'code-symbol-korean'), false) AS code_found FROM h),
fs AS (SELECT query_id, doc_id, {_ROUND.format(f"{_ROUND.format('0.5::DOUBLE / rank')} + {_ROUND.format('0.5::DOUBLE / (101 - rank)')}")} AS score FROM br WHERE rank <= 100),
fr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fs),
fh AS (SELECT query_id, count(*) FILTER (WHERE rank <= 5) AS hits, min(rank) AS first FROM fr JOIN rel USING (query_id, doc_id) GROUP BY ALL),
fm AS (SELECT category, {_ROUND.format("avg(CASE WHEN n.n > 0 THEN coalesce(hits, 0) / n.n::DOUBLE ELSE 0 END)")} AS r, {_ROUND.format("avg(coalesce(1.0::DOUBLE / first, 0))")} AS m FROM qs LEFT JOIN n USING (query_id) LEFT JOIN fh USING (query_id) GROUP BY category),
lo AS (SELECT coalesce(bool_or(fm.category IS NULL OR fm.r < mt.recall_at_5 OR fm.m < mt.mrr), false) AS hybrid_lower FROM mt LEFT JOIN fm USING (category) WHERE mt.mode = 'semantic')
SELECT *, gained AND NOT lost AND code_found AND NOT hybrid_lower AS passed FROM f, lo"""
COMPARE_SQL = COMPARE_SQL.replace("h AS (SELECT qs", "hh AS (SELECT qs").replace("FROM h)", "FROM hh)")


def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_digest(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang"])


DIGEST_SQL = """
WITH o AS (SELECT sha256(to_json({'doc_id': doc_id, 'text': text, 'lang': lang})::VARCHAR) AS d, count(*) AS n FROM documents GROUP BY 1),
p AS (SELECT substr(d, 1, 3) AS b, sum(n) AS n, sha256(string_agg(d || ':' || n, '' ORDER BY d || ':' || n)) AS d FROM o GROUP BY 1)
SELECT sum(n)::BIGINT AS pages, 'sha256:' || sha256(string_agg(d, '' ORDER BY b)) AS digest FROM p"""

QUERIES = {f.__name__: f for f in (lexical_search, token_stats, hangul_ngrams, field_evidence, postings_sizes, batch_search, semantic_rank, hybrid_search, eval_metrics, eval_gates, eval_regression, candidate_compare, corpus_digest)}
ORACLES = {
    "lexical_search": LEXICAL_SQL, "token_stats": TOKENS_SQL, "hangul_ngrams": HANGUL_SQL, "field_evidence": EVIDENCE_SQL, "postings_sizes": POSTINGS_SQL,
    "batch_search": BATCH_SQL, "semantic_rank": SEMANTIC_SQL, "hybrid_search": HYBRID_SQL, "eval_metrics": METRICS_SQL, "eval_gates": GATES_SQL,
    "eval_regression": REGRESSION_SQL, "candidate_compare": COMPARE_SQL, "corpus_digest": DIGEST_SQL,
}
