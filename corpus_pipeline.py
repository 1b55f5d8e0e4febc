"""The corpus pipeline: quality, near duplicates, benchmark decontamination, secrets, piece encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; all but the
last return the columns of ``documents``. Labels and the benchmark come from ``sf_dir``. Rows with null or empty text are
judged like any others: the classifier decides on them, and later stages keep them. Empty tables give no rows, very long
texts are read whole, and extra columns stay as they are, whatever their names. Rows that repeat an id are judged each by its
own text; of rows that repeat id and text the near-duplicate stage keeps one. Ties are settled by the smallest id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tarnfield.llm import decontaminate, jaccard, pieces, quality, secrets
from tarnfield.llm.graph import shared_folder
from tarnfield.llm.textkit import fold_rule


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below 0.5. Fitted on labels outside the held-out fold."""
    labels = _table(spark, sf_dir, "labels").where(~fold_rule("doc_id", 3, 1))
    return quality.keep_good(docs, quality.fit_quality(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of the n-gram Jaccard join, on five-word shingles at 0.8."""
    return jaccard.keep_first(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which ten consecutive words of a benchmark item occur."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text; drops nothing."""
    return secrets.redact(docs, secrets.fit_markov(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the text's pieces with its three best segmentations."""
    return pieces.encode_texts(docs, pieces.PieceModel.load(pieces.public_model_path()), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("SentencePiece encoding and decoding", encoded),
]

#: The first stage is a fitted model and the last a lattice search: no SQL gives their rows.
ORACLE_SQL = None


def _forget(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written to the shared folder and read again.

    A stage's rows are deleted when those of the next are written; the last ones stay, as the result is read from them.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            _forget(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
