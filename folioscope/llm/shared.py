"""What the training-data operators share: checkpoints, Arrow text blocks, vector hashes.

Texts are handled as UTF-8 bytes in the Arrow buffers that Spark hands to a Python
worker.  A batch is cut into blocks of about ``BLOCK_BYTES`` (one longer text is a
block of its own), so a worker's arrays stay small however many rows a batch has.
Workers live on between stages; after each batch they hand freed memory back.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 19

#: ASCII white space: space and \t \n \v \f \r.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own, or (only where none is set, and all runs on one machine) a new one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioscope-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint; use it for narrow rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


SLOTS = 1 << 22


def among(rows: DataFrame, wanted: DataFrame, column: str, schema: str) -> DataFrame:
    """Most rows whose value of an integer column is not in wanted are left out, none that is in it.

    A bit table of fixed size, so that texts nobody asks for stay out of the join that follows.
    """
    slots = wanted.select(F.col(column).bitwiseAND(SLOTS - 1).alias("slot")).distinct().toArrow().column("slot").to_numpy()
    bits = np.zeros(SLOTS, bool)
    bits[slots] = True
    table = np.packbits(bits, bitorder="little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(column).to_numpy(zero_copy_only=False) & (SLOTS - 1)
            found = table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
            yield batch.filter(pa.array(found.astype(bool)))

    return rows.select(*(x.split()[0] for x in schema.split(", "))).mapInArrow(run, schema)


class Block:
    """Some consecutive rows of a text column as one byte array with row offsets."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per row, the sum of a value per byte."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of a string column in order; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, len(column))
        yield Block(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
    give_back()


def give_back() -> None:
    """Freed memory goes back to the machine, as other processes of the executor need it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


#: Bytes of words that white space separates.
NON_SPACE = ~byte_class(SPACE_BYTES)
#: Bytes of words of letters, digits and everything beyond ASCII (after lower-casing).
WORD_CHARS = byte_class(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: 1 for each byte that starts a code point.
STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80


def word_spans(block: Block, data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) of the words of all rows, and each row's first word (one more at the end)."""
    mask = table[data]
    n = len(mask)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(block.rows + 1, np.int64)
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    at = block.offsets[:-1]
    before[at[at < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    after[block.offsets[1:][block.offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, block.offsets)


_RNG = np.random.default_rng(20240229)
_SYMBOL = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, m in enumerate((_M, _M_INV)):
            steps = np.full(n, m, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial sums mod 2**64, from which span_hash takes the hash of any span."""
    up, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOL[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes have equal hashes wherever they stand."""
    _, down = _power_tables(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_of(words: list[bytes]) -> np.ndarray:
    """span_hash of separate byte strings."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if words else ends
    return span_hash(prefix_hash(data), starts, ends)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]; values may have a second axis."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def byte_ngrams(data: np.ndarray, n: int) -> np.ndarray:
    """For each position but the last n-1, the n bytes from there as one integer (n at most 8)."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    out = data[: len(data) - n + 1].astype(np.uint64)
    for k in range(1, n):
        out |= data[k : len(data) - n + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    return out


def ngram_rows(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's first n-gram position and one past its last; n-grams never span two rows."""
    lo = block.offsets[:-1]
    return lo, np.maximum(lo, block.offsets[1:] - n + 1)
