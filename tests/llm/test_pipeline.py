"""The corpus pipeline from end to end on rows that hold every odd case, against what each stage should do by hand."""

import random

import pytest

import corpus_pipeline
from tarnfield.llm import pieces, quality, secrets
from tarnfield.llm.textkit import fold_rule

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "zero one two three four five six seven eight nine ten eleven twelve"


def write(spark, folder, docs, labels, benchmark):
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(2)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    prose = lambda n=40: " ".join(rnd.choices(vocabulary, k=n))
    docs = [(i, prose() if i % 3 else " ".join(rnd.choices(["###", "$$$", "%%%", "@@@"], k=30)), "en", "s", 1) for i in range(120)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(120)]
    original = prose(200)
    docs += [(200, original, "en", "s", 1), (201, original, "en", "s", 1), (201, original, "en", "s", 1), (202, original.replace(original.split()[50], "changed", 1), "en", "s", 1)]
    docs += [(300, f"{prose()} {ITEM} {prose()}", "en", "s", 1), (301, f"{prose()} password: abc123xyz789 {prose(20)}", None, None, None)]
    docs += [(400, None, None, None, None), (401, "", "en", "s", 0), (None, prose(), "en", "s", 1), (402, prose(30_000), "en", "s", 1)]
    folder = str(tmp_path_factory.mktemp("tables"))
    write(spark, folder, docs, labels, [(1, ITEM), (2, None), (1, ITEM)])
    return folder, docs


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding"]


def test_pipeline_end_to_end(spark, tables):
    folder, docs = tables
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = {r.doc_id for r in rows}
    good = {i for i, t, *_ in docs if i is not None and i < 120 and i % 3}
    assert kept & set(range(120)) == good
    # Of the copies one stays; the benchmark's item is out; the secret is masked, its document stays; odd rows stay or go by score.
    assert kept & {200, 201, 202} == {200}
    assert 300 not in kept
    assert {301, 402} <= kept
    model = pieces.PieceModel.load(pieces.public_model_path())
    texts = {r.doc_id: model.decode(r.ids) for r in rows}
    assert "abc123xyz789" not in texts[301]
    assert "[secret]" in texts[301]
    whole = {i: t for i, t, *_ in docs}
    assert texts[402] == whole[402]
    assert all(texts[i] == whole[i] for i in good)
    assert all(r.round_trip for r in rows)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~fold_rule("doc_id", 3, 1))
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    first = quality.keep_good(frame, quality.fit_quality(frame, labels))
    blank = {r.doc_id for r in first.where("coalesce(text, '') = ''").collect()}
    assert kept & {400, 401} == blank
    assert (None in kept) == (first.where("doc_id is null").count() > 0)


def test_each_stage_keeps_columns_and_takes_empty_tables(spark, tables):
    folder, _ = tables
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, folder)
        assert out.count() == 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == empty.columns


def test_extra_columns_with_clashing_names(spark, tables):
    from pyspark.sql import functions as F

    folder, _ = tables
    names = ("score", "ids", "best", "n", "component_id", "_text", "_id", "again", "row", "spans", "items")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id in (1, 2, 200, 201)")
    docs = docs.select("*", *(F.lit(1).alias(x) for x in names), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert out.count() >= 3
    encoded = pieces.encode_texts(docs, pieces.PieceModel.load(pieces.public_model_path()), keep=("doc_id", "ids", "best"))
    assert encoded.columns == ["doc_id", "_ids", "_best", "n_pieces", "ids", "best", "round_trip"]
    decoded = pieces.decode_ids(encoded.withColumn("text", F.lit("old")), pieces.PieceModel.load(pieces.public_model_path()))
    assert decoded.columns[-1] == "text"
    assert {r.text for r in decoded.collect()} == {r.text for r in docs.collect()}
    assert secrets.redact(docs, secrets.fit_markov(docs)).count() == docs.count()
