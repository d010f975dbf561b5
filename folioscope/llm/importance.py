"""Target-distribution importance resampling over a sparse document-by-bucket count matrix.

Every run of 1 to ``runs`` consecutive words is a feature and falls into one of ``buckets``
by its CRC-32.  The counts of the documents are written once, as a table of CSR blocks (some
consecutive rows of the matrix: row pointers, column numbers, counts).  From it:

* column sums give the distribution of the documents; those of a target text set give the
  target's, and the smoothed log ratio of the two is the gain of a bucket;
* a sparse matrix-vector product of each block with the gains gives the weights.

Gumbel noise, a function of the document's id alone, is added to the weights; the highest
scores are a sample without replacement in which the chance grows with the weight.

Scale: texts are read once, and nothing is shuffled but partial column sums (pre-added in
each task) and, for the ranks, three numbers a document, dealt by ranges of the score: the
rank is the place in the range behind the sizes of the ranges before it.  The driver sees one
sum a bucket and one size a range.  Blocks hold some ``BLOCK_BYTES`` of text, so a matrix row
of a very long text is a block of its own.  The table is written in row groups of some
``GROUP_BYTES``: a reader holds one of them decoded, however large a file is.

Defined cases: null, empty and word-free texts have no features and weight 0; a row without
an id has no noise, so no score, and is never drawn nor counted among those to draw from;
equal rows have equal scores and ranks of their own; an empty target has equal buckets; other
columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import LOWER, WORD_CHARS, blocks, cut, drop_folder, ensure_checkpoint_dir, row_sums

BUCKETS, RUNS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: The gains go to every task, eight bytes a bucket.
MAX_BUCKETS = 1 << 22
#: Row groups of the matrix; their size is looked at after every few blocks, as one is large.
GROUP_BYTES, GROUP_CHECK = 4 << 20, 4

#: Lower-cased word bytes; a space for everything between words.
_WORDS = bytes(int(LOWER[b]) if WORD_CHARS[LOWER[b]] else 0x20 for b in range(256))
_CSR = "ids array<long>, n_words array<int>, row_ptr array<int>, cols array<int>, counts array<int>"


def feature_buckets(text: bytes, buckets: int = BUCKETS, runs: int = RUNS) -> tuple[int, np.ndarray]:
    """Number of words of a text, and the bucket of each of its features."""
    words = text.translate(_WORDS).split()
    hashes = [np.fromiter(map(zlib.crc32, words), np.int64, len(words))]
    for n in range(2, runs + 1):
        many = max(0, len(words) - n + 1)
        hashes.append(np.fromiter((zlib.crc32(b" ".join(words[i : i + n])) for i in range(many)), np.int64, many))
    return len(words), np.concatenate(hashes) % buckets


def count_matrix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """The count matrix in CSR blocks: ids and word counts of the rows, row pointers, columns, counts."""
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"1 to {MAX_BUCKETS} buckets, not {buckets}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = [feature_buckets(block.text(i), buckets, runs) for i in range(block.rows)]
                size = np.array([len(f) for _, f in found], np.int64)
                entry, counts = np.unique(np.repeat(np.arange(block.rows), size) * buckets + np.concatenate([f for _, f in found]), return_counts=True)
                row, cols = np.divmod(entry, buckets)
                ptr = np.searchsorted(row, np.arange(block.rows + 1))
                one = lambda values, kind: pa.array([values], pa.list_(kind))
                ids = pa.ListArray.from_arrays(pa.array([0, block.rows], pa.int32()), batch.column(0).slice(block.first, block.rows))
                yield pa.record_batch(
                    [ids, one(np.array([n for n, _ in found], np.int32), pa.int32()), one(ptr.astype(np.int32), pa.int32()), one(cols.astype(np.int32), pa.int32()), one(counts.astype(np.int32), pa.int32())],
                    names=["ids", "n_words", "row_ptr", "cols", "counts"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _CSR)


def write_matrix(matrix: DataFrame, folder: str) -> None:
    """The blocks as a table whose row groups are small enough for any reader."""
    matrix.write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size.row.check.min", GROUP_CHECK).option("parquet.page.size.row.check.max", GROUP_CHECK).parquet(folder)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            cols, counts = (batch.column(c).flatten().to_numpy() for c in ("cols", "counts"))
            np.add.at(total, cols, counts)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    summed = matrix.select("cols", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


def bucket_gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets)))) of each bucket."""
    m = len(own)
    whole, wanted = float(own.sum() + m), float(target.sum() + m)
    return np.array([math.floor(1000 * math.log((t + 1) * whole / ((s + 1) * wanted))) for s, t in zip(own.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weigh(matrix: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row: the matrix times the gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ptr, cols, counts = (batch.column(c)[i].values.to_numpy() for c in ("row_ptr", "cols", "counts"))
                counts = counts.astype(np.int64)
                yield pa.record_batch(
                    [batch.column("ids")[i].values, batch.column("n_words")[i].values.cast(pa.int64()), pa.array(row_sums(counts, ptr)), pa.array(row_sums(counts * gains[cols], ptr))],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noisy(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows with score: weight and Gumbel noise that depends on the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + gumbel.cast("long"))


def rank_highest(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows with rank: 1, 2, 3... by falling score, then id, of the given share of those with enough words."""
    may = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc("doc_id")]
    # the identifier holds the number of the range and, in its lower 33 bits, the place in it
    placed = cut(scored.filter(may).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    sizes = placed.groupBy(part).count().orderBy("part").collect()
    drawn = percent * sum(r["count"] for r in sizes) // 100
    before, rows = 0, []
    for r in sizes:
        rows.append((r["part"], before))
        before += r["count"]
    starts = scored.sparkSession.createDataFrame(rows, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= drawn, rank))
    rest = scored.filter(~F.coalesce(may, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).union(rest)


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, runs: int = RUNS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """Per document row: doc_id, n_words, n_features, weight, score, and rank if it is drawn."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/counts-{uuid.uuid4().hex}"
    write_matrix(count_matrix(docs, id_col=id_col, text_col=text_col, buckets=buckets, runs=runs), folder)
    matrix = spark.read.schema(_CSR).parquet(folder)
    wanted = count_matrix(target.select(F.lit(None).alias("doc_id"), F.col(target_col).alias("text")), buckets=buckets, runs=runs)
    gains = bucket_gains(column_sums(matrix, buckets), column_sums(wanted, buckets))
    scored = cut(noisy(weigh(matrix, gains), seed))
    drop_folder(spark, folder)
    return rank_highest(scored, least_words, percent)


def draw(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents, with all their columns; rows that share an id go together.  ``options`` are those of ``resample``."""
    drawn = resample(docs, target, id_col=id_col, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id"))
    return docs.join(drawn, docs[id_col].cast("long") == drawn.drawn_id, "left_semi")
