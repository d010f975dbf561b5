"""Training corpus from raw documents: five stages, each written as Parquet and read again.

quality rules -> near-duplicates -> benchmark decontamination -> personal data ->
mixing to target weights.  Every stage takes the rows its predecessor kept and returns the
columns of ``documents``; n_chars follows the text where a stage edits it.

Where run() writes: a fresh folder under the session's shared checkpoint folder; a stage's
folder goes when the next stage has been written, the last one stays for the caller.

Defined cases, for every stage: other columns, whatever their names, pass through; null
ids are ids of their own; rows with equal id and text share every decision, and the
near-duplicate stage keeps one of them; an empty table gives an empty table.  Null, empty
and short texts fail the quality rules (fewer than 50 words); further stages take them as
texts without words, hits or spans.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, mixing, near_copies, pii, quality
from folioscope.llm.shared import ensure_checkpoint_dir, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trained verdict go; the model learns from all labelled rows of docs."""
    return quality.keep_quality(docs, quality.train_quality(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows whose word 5-shingles have a Jaccard similarity of 0.8 or more the one with the smallest doc_id stays.

    Fingerprints are linked by op8's trie self-join within five bits and held against the exact
    similarity; a budget of bits for all copies of 0.8 would compare nearly all pairs, so those
    beyond it are found by their shingles.  Of rows without words one stays.
    """
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark windows go; a document of which more than four fifths are such spans goes as a whole."""
    clean = decontaminate.remove_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return _counted(clean, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in angle brackets; no document goes."""
    return _counted(pii.redact(docs), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target shares of languages and forms, and tempered shares of sources."""
    return mixing.sample_mixture(docs, targets=mixing.TARGETS)


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("simhash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing", mixing_stage),
]

#: Trained stages have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
