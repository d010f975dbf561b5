"""SimHash near-duplicates: 64-bit fingerprints linked by a binary-trie self-join.

A fingerprint bit is 1 if it is set in over half the XXH64 values (seed 42) of a text's
word 3-shingles.  Distinct fingerprints are dealt by each of three bit fields: two that
differ in at most two bits agree in one field, so every link shows up in some bucket.
In a bucket the fingerprints form a binary trie; pairs of its nodes are traversed
together, level by level, adding up differing bits and dropping a pair as soon as it
exceeds the budget.  A leaf pair is a link.  A bucket gives back a spanning forest of its
links, not all of them, so what leaves a bucket is linear in it.

Components over the fingerprints come from repeated contraction of the links on
DataFrames; nothing is gathered on the driver but one count a round.

Scale: copies collapse to their fingerprint before any bucket is formed.  A bucket with
more than ``hot_bucket`` fingerprints is dealt again by three fields of its other bits
(at two differing bits, one of those agrees as well), so a hot field value is split
without losing a link.  Joins are plain equi-joins that AQE may split.

Defined cases: null, empty and word-free texts have fingerprint zero and link like any
other; texts of one or two words hash the whole sequence; a component is named by its
smallest non-null doc_id (null if all are null); repeated rows and ids each give a row;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import cut, drop_folder, ensure_checkpoint_dir

SHINGLE, SEED, BITS = 3, 42, 64
BUDGET = 2
HOT_BUCKET = 50_000


def fields(budget: int = BUDGET) -> list[tuple[int, int]]:
    """(lowest bit, width) of the fields, one more than differing bits (three at least), so that one is untouched."""
    n = max(3, budget + 1)
    return [(k * BITS // n, (k + 1) * BITS // n - k * BITS // n) for k in range(n)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts[:n], ends[min(shingle, len(words)) - 1 :])), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; none of no hashes."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns kept, and fp (the fingerprint as a signed 64-bit integer) of each document row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.drop("text").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1).cast(pa.binary())
            values = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in column), np.uint64, len(column))
            yield pa.record_batch([*batch.columns[:-1], pa.array(values.view(np.int64))], names=["doc_id", *keep, "fp"])

    return narrow.mapInArrow(run, f"{kinds}, fp long")


class _Forest:
    """Union-find over 0..n-1 on vectors of pairs; roots are the smallest members."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            apart = lo != hi
            a, b, lo, hi = a[apart], b[apart], lo[apart], hi[apart]
            np.minimum.at(self.parent, hi, lo)


def trie_links(keys: np.ndarray, bucket: np.ndarray, budget: int = BUDGET, most: int = 1 << 18) -> np.ndarray:
    """For keys sorted within sorted buckets, the smallest index each is linked to, transitively.

    A trie node is a range of the sorted keys whose leading bits agree.  A frontier of
    node pairs (with their differing bits so far) goes down one bit at a time; it is
    worked off in pieces of at most ``most`` pairs, so memory stays bounded.
    """
    n = len(keys)
    forest = _Forest(n)
    if n < 2:
        return np.arange(n)
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    lo, hi = edges, np.r_[edges[1:], n]
    many = hi - lo > 1
    zero = np.zeros(int(many.sum()), np.int64)
    #: Below each index, how many keys have a bit set: the 1-child of a range starts where its zeros end.
    ones: dict[int, np.ndarray] = {}

    def below(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]
        return ones[bit]

    stack = [(BITS - 1, lo[many], hi[many], lo[many], hi[many], zero)]
    while stack:
        bit, a0, a2, b0, b2, errors = stack.pop()
        if bit < 0:
            apart = a0 != b0
            forest.union(a0[apart], b0[apart])
            continue
        if len(a0) > most:
            half = len(a0) // 2
            stack.append((bit, *(x[half:] for x in (a0, a2, b0, b2, errors))))
            stack.append((bit, *(x[:half] for x in (a0, a2, b0, b2, errors))))
            continue
        count = below(bit)
        a1, b1 = a2 - (count[a2] - count[a0]), b2 - (count[b2] - count[b0])
        same = a0 == b0
        parts = [
            (a0, a1, b0, b1, errors, None),
            (a1, a2, b1, b2, errors, None),
            (a0, a1, b1, b2, errors + 1, None),
            (a1, a2, b0, b1, errors + 1, ~same),
        ]
        out: list[list[np.ndarray]] = []
        for x0, x2, y0, y2, e, also in parts:
            ok = (x0 < x2) & (y0 < y2) & (e <= budget)
            if also is not None:
                ok &= also
            # a node paired with itself only matters while it holds two keys
            ok &= (x0 != y0) | (x2 - x0 > 1)
            out.append([v[ok] for v in (x0, x2, y0, y2, e)])
        nxt = [np.concatenate([p[k] for p in out]) for k in range(5)]
        if len(nxt[0]):
            stack.append((bit - 1, *nxt))
    return forest.roots(np.arange(n))


def bucket_links(distinct: DataFrame, budget: int = BUDGET, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links (a, b) between fingerprints: a spanning forest of every bucket's links.  At hot_bucket 0 all buckets are dealt again."""
    field = lambda at, width: F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1)
    dealt = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), field(*f).alias("v")) for k, f in enumerate(fields(budget))))).alias("f")).select("fp", (F.col("f.k") * (1 << 22) + F.col("f.v")).alias("bucket"))
    if hot_bucket:
        counts = dealt.groupBy("bucket").count().filter(F.col("count") > hot_bucket).select("bucket", F.lit(True).alias("hot"))
        dealt = dealt.join(counts, "bucket", "left")
    else:
        dealt = dealt.withColumn("hot", F.lit(True))
    # a hot bucket is dealt again by as many fields of a mixed-radix split of its other bits
    sub = F.array(*(F.struct(F.lit(j).alias("j"), F.expr(_sub_field(j, budget)).alias("s")) for j in range(len(fields(budget)))))
    none = F.array(F.struct(F.lit(0).alias("j"), F.lit(0).cast("long").alias("s")))
    dealt = dealt.select("fp", "bucket", F.explode(F.when(F.col("hot"), sub).otherwise(none)).alias("x"))
    dealt = dealt.select(F.xxhash64("bucket", "x.j", "x.s").alias("bucket"), "fp").repartition("bucket").sortWithinPartitions("bucket", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: list[np.ndarray]) -> pa.RecordBatch:
            both = np.concatenate(rows, axis=1)
            keys = both[1].view(np.uint64)
            order = np.lexsort((keys, both[0]))
            keys, bucket = keys[order], both[0][order]
            root = trie_links(keys, bucket, budget)
            linked = np.flatnonzero(root != np.arange(len(root)))
            return pa.record_batch([pa.array(keys[linked].view(np.int64)), pa.array(keys[root[linked]].view(np.int64))], names=["a", "b"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)])
            cuts = np.flatnonzero(part[0][1:] != part[0][:-1]) + 1
            if held and part[0][0] != held[-1][0][-1] and size > 1 << 19:
                yield flush(held)
                held, size = [], 0
            if size + part.shape[1] > 1 << 20 and len(cuts):
                yield flush([*held, part[:, : cuts[-1]]])
                held, size = [], 0
                part = part[:, cuts[-1] :]
            held.append(part)
            size += part.shape[1]
        if held:
            yield flush(held)

    return dealt.mapInArrow(run, "a long, b long")


def _sub_field(j: int, budget: int = BUDGET) -> str:
    """SQL for part j of the bits outside field k of a bucket, as one integer."""
    out = []
    n = len(fields(budget))
    for k, (at, width) in enumerate(fields(budget)):
        rest = [b for b in range(BITS) if not at <= b < at + width]
        part = rest[j * len(rest) // n : (j + 1) * len(rest) // n]
        mask = sum(1 << b for b in part)
        out.append(f"WHEN {k} THEN fp & {mask - (1 << 64) if mask >> 63 else mask}L".replace("& -9223372036854775808L", "& (-9223372036854775807L - 1L)"))
    return f"CASE shiftright(bucket, 22) {' '.join(out)} END"


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links, root being the smallest node reachable.

    Each round gives every node the first of its neighbours and itself, in an order that is
    dealt anew by hash, and goes on from there once more; the links are then those between
    the nodes given, each once.  So a link is looked up once and not in every round: links
    inside a group are gone after a round or two, however many they are.

    Rounds are written as Parquet: a checkpoint keeps the estimated size of its plan, which
    every join multiplies, until the number itself no longer fits the driver.
    """
    spark = links.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/components-{uuid.uuid4().hex}"

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    try:
        edges = kept(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        passed: list[DataFrame] = []
        while not passed or not edges.isEmpty():
            k = len(passed)
            if k == rounds:
                raise RuntimeError(f"components have not settled in {rounds} rounds")
            place = lambda x, k=k: F.struct(F.xxhash64(F.lit(k), x).alias("h"), F.col(x).alias("to"))
            both = edges.select(F.col("a").alias("node"), place("b").alias("p")).union(edges.select(F.col("b").alias("node"), place("a").alias("p")))
            first = both.groupBy("node").agg(F.min("p").alias("p")).select("node", F.least("p", place("node"))["to"].alias("to"))
            onward = first.select(F.col("node").alias("to"), F.col("to").alias("up"))
            given = kept(first.join(onward, "to").select("node", F.col("up").alias("to")), f"given-{k}")
            passed.append(given)
            ends = edges.join(given.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
            ends = ends.join(given.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
            edges = kept(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"links-{k}")
        label = passed.pop()
        while passed:
            onward = label.select(F.col("node").alias("to"), F.col("to").alias("last"))
            label = passed.pop().join(onward, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
        return cut(label.join(label.groupBy("to").agg(F.min("node").alias("root")), "to").select("node", "root"))
    finally:
        drop_folder(spark, folder)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, hot_bucket: int = HOT_BUCKET, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: doc_id, the columns kept, fingerprint (hex), component_id (its smallest doc_id), and root.

    root is the smallest fingerprint of the component, as a signed integer.
    """
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, keep=keep))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(bucket_links(distinct.select("fp"), budget, hot_bucket))
    named = cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(names, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp").select("doc_id", *keep, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the smallest id.

    Rows with a null id come last in their group; of rows with equal id and text one stays.
    """
    own, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("document"), own.alias("doc_id"), text.alias("text"), F.coalesce(own, F.lit(0).cast("long")).alias("key"), F.xxhash64(text, text.isNull(), own.isNull()).alias("tag"))
    found = near_duplicates(held, shingle=shingle, budget=budget, keep=("key", "tag"))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "key", "tag")).alias("b")).select("b.key", "b.tag")
    return held.join(best, ["key", "tag"], "left_semi").dropDuplicates(["key", "tag"]).select("document.*")
