"""The registered queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm import codes, decontaminate, fim, html, jaccard, langid, linededup, pieces, quality, secrets, toxicity, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(_table(spark, sf_dir, "pages"))


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit_query(_table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_query(_table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.neighbours_query(_table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digest(found)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(_table(spark, sf_dir, "documents"), pieces.PieceModel.load(pieces.public_model_path()))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.secret_digest(secrets.scan_secrets(docs, secrets.fit_markov(docs)))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digest(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.middle_digest(fim.fill_in_middle(_table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes_query(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_text, op2_merkle_fixity, op3_language_id, op4_neighbours, op5_quality, op6_toxicity, op7_ngram_jaccard, op8_decontamination, op9_pieces, op10_secrets, op11_line_dedup, op12_fill_in_middle, op13_vector_codes)}


_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = """
WITH p AS (SELECT page_id, url, html, sha256(html) AS h, chr(13) || chr(10) AS e FROM pages),
r AS (SELECT page_id, 'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]
  || '>' || e || 'WARC-Date: 2024-01-01T00:00:00Z' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'WARC-Block-Digest: sha256:' || h || e
  || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(html) || e || e || html || e || e AS rec FROM p),
d AS (SELECT page_id, coalesce(strlen(rec), 0) AS length, coalesce(sha256(rec), 'null') AS digest, 'pages-' || lpad((page_id // 256)::VARCHAR, 12, '0') || '.warc' AS file FROM r),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM d)
SELECT file, "offset", length, 1::BIGINT AS n_records, sha256(digest || ':' || length || ':1') AS hash, CASE page_id % 101 WHEN 0 THEN 'changed' WHEN 1 THEN 'lost' ELSE 'ok' END AS status FROM o"""

OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOW.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT row, doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT row, doc_id, len(s) AS n FROM s),
u AS (SELECT row, unnest(s) AS g FROM s),
c AS (SELECT a.row AS a, b.row AS b, count(*) AS common FROM u a JOIN u b ON a.g = b.g AND a.row <> b.row GROUP BY ALL),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM c JOIN n x ON c.a = x.row JOIN n y ON c.b = y.row WHERE 100 * common >= 90 * (x.n + y.n - common)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, m.least AS component_id FROM n JOIN m ON n.doc_id = m.a"""

OP8_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOW.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i + 1, i + least(10, len(w))), ' ') AS g FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM w, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN iw USING (g, k)),
p AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at FROM h) GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY ALL)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT row, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
k AS (SELECT *, {_LOW.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM u),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(f.last <> k.doc_id, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY row"""

OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM s),
p AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:n], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _op13_sql(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Lloyd's rounds written out one after the other over all pairs of parts and entries."""
    steps = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT vec_id, label, part, q[part * (len(q) // {parts}) + 1 : (part + 1) * (len(q) // {parts})] AS v FROM k, (SELECT unnest(range({parts})) AS part))",
        f"b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM p QUALIFY entry < {entries})",
    ]
    for i in range(rounds + 1):
        distance = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
        steps.append(f"a{i} AS (SELECT vec_id, part, any_value(v) AS v, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT vec_id, part, v, entry, {distance} AS d FROM p JOIN b{i} USING (part)) GROUP BY vec_id, part)")
        if i < rounds:
            means = f"SELECT part, entry, place, floor(sum(x) / count(*)) AS m FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS place FROM a{i}) GROUP BY ALL"
            steps.append(f"b{i + 1} AS (SELECT part, entry, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN (SELECT part, entry, list(m ORDER BY place) AS c FROM ({means}) GROUP BY ALL) n USING (part, entry))")
    steps.append(f"e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS h FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM e JOIN k USING (vec_id), h"


OP13_SQL = _op13_sql()


def oracle_sql() -> dict[str, str]:
    """The other queries are fitted models, rules over markup or approximate searches: they are tested otherwise."""
    return {"op2_merkle_fixity": OP2_SQL, "op7_ngram_jaccard": OP7_SQL, "op8_decontamination": OP8_SQL, "op11_line_dedup": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_vector_codes": OP13_SQL}
