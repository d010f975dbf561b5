"""Quality rules: counted base rules, then a hashed n-gram logistic regression.

Features are hashed word 1- and 2-grams (lower-cased words of letters and digits) and
byte 3- and 4-grams of the raw text.  Two heads are trained on the labelled rows: *low
quality* on n-gram frequencies, and *toxic* on the presence of words, and of the first
4 and 5 bytes of words (compounds and inflections of a rude word share them), that a
screening test finds over-represented in toxic rows, so that one rude word counts in a
long text.  Each head is calibrated (Platt) on rows it was not
fitted on, and a document is kept if it passes the base rules and both calibrated
probabilities stay under fixed thresholds.

Scale: at most ``max_labelled`` labelled rows (those with the smallest hash of their id)
with at most ``max_bytes`` of text, and ``max_full`` of them for the low-quality head, are
turned into sparse counts on the executors and fitted by one task; scoring is one
pass in Arrow batches without a shuffle, over whole texts, with weights of fixed size.

Defined cases: a null or empty text has no words and fails the base rules; rows with a
null label are not learned from, of several labels of one document the lowest quality and
highest toxicity count, of several texts the one with the least hash; with no rows of some class that head rejects nothing; repeated
document rows each get their row; extra columns pass through :func:`keep_quality`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import LOWER, NON_SPACE, STARTS_CHAR, WORD_CHARS, Block, blocks, byte_class, byte_ngrams, cut, give_back, mix, ngram_rows, prefix_hash, row_sums, span_hash, word_spans

#: Labelled rows that are learned from, those of them that the low-quality head (whose features are many) takes, and bytes of their texts.
MAX_LABELLED, MAX_FULL, MAX_BYTES = 4096, 2400, 16 << 20
#: A document goes if its calibrated probability of low quality, or of toxicity, reaches these.
LOW_QUALITY_LIMIT, TOXIC_LIMIT = 0.5, 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

UNI, BI, CHAR, START = 1 << 17, 1 << 16, 1 << 16, 1 << 17
#: Places of the features: words, pairs, byte n-grams, and from FIRST_START the starts of words.
FIRST_START = UNI + BI + CHAR
DIM = FIRST_START + START
START_BYTES = (4, 5)
SYMBOLS = byte_class(b"#*$%&|<>")
FEATURE_SCALE = 100.0


def base_counts(block: Block, texts: list[bytes] | None = None) -> dict[str, np.ndarray]:
    """The counted rules of each row of a block, over whole texts."""
    data = block.data
    starts, ends, first = word_spans(block, data, NON_SPACE)
    n_words = np.diff(first)
    hashes = span_hash(prefix_hash(data), starts, ends)
    n_repeat = np.zeros(block.rows, np.int64)
    if len(hashes) >= 3:
        row = np.repeat(np.arange(block.rows), n_words)
        grams = mix(mix(hashes[:-2] + np.uint64(1)) + hashes[1:-1])
        grams = mix(grams + hashes[2:])
        whole = np.flatnonzero(row[2:] == row[:-2])
        keys = mix(grams[whole] + row[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(keys), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        hit = np.zeros(len(hashes), bool)
        at = whole[again]
        for k in range(3):
            hit[at + k] = True
        n_repeat = row_sums(hit, first)
    n_dup = np.zeros(block.rows, np.int64)
    for i in range(block.rows):
        lines = block.text(i).split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x.strip()]
            n_dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": n_words,
        "word_chars": block.sums(NON_SPACE[data] & STARTS_CHAR[data]),
        "n_symbols": block.sums(SYMBOLS[data]),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
    }


def hashed_features(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of (feature, first position of each row, one more at the end): words, pairs, byte n-grams, starts of words."""
    data = LOWER[block.data]
    starts, ends, first = word_spans(block, data, WORD_CHARS)
    sums = prefix_hash(data)
    hashes = span_hash(sums, starts, ends)
    uni = (hashes >> np.uint64(64 - 17)).astype(np.int64)
    row = np.repeat(np.arange(block.rows), np.diff(first))
    keep = np.flatnonzero(row[1:] == row[:-1]) if len(row) > 1 else np.zeros(0, np.int64)
    pair = mix(hashes[keep] * np.uint64(3) + hashes[keep + 1]) if len(keep) else np.zeros(0, np.uint64)
    out = [(uni, first), ((pair >> np.uint64(48)).astype(np.int64) + UNI, np.searchsorted(keep, first))]
    for n in (3, 4):
        grams = (mix(byte_ngrams(block.data, n) + np.uint64(n)) >> np.uint64(48)).astype(np.int64) + (UNI + BI)
        lo, hi = ngram_rows(block, n)
        inside = np.zeros(len(grams) + 1, np.int64)
        np.add.at(inside, np.minimum(lo, len(grams)), 1)
        np.add.at(inside, np.minimum(hi, len(grams)), -1)
        keep = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
        out.append((grams[keep], np.searchsorted(keep, block.offsets)))
    lengths = np.array(START_BYTES)
    whole = np.flatnonzero((ends - starts)[:, None] >= lengths)
    word, n = whole // len(lengths), lengths[whole % len(lengths)]
    heads = span_hash(sums, starts[word], starts[word] + n)
    out.append(((heads >> np.uint64(64 - 17)).astype(np.int64) + FIRST_START, np.searchsorted(word, first)))
    return out


@dataclass
class Head:
    """A linear score over hashed counts and its Platt calibration."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIM, np.float32))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = -20.0
    by_frequency: bool = True

    def logits(self, groups: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.full(len(groups[0][1]) - 1, self.bias)
        if self.by_frequency:
            for features, first in groups:
                out += row_sums(self.weights[features].astype(np.float64), first) * FEATURE_SCALE / np.maximum(np.diff(first), 1)
            return out
        for features, first in (groups[0], groups[-1]):
            at = np.flatnonzero(self.weights[features])
            present = np.unique((np.searchsorted(first, at, "right") - 1) * DIM + features[at])
            np.add.at(out, present // DIM, self.weights[present % DIM])
        return out

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -30, 30)))


def _chosen(docs: DataFrame, labels: DataFrame, max_labelled: int, max_full: int, max_bytes: int) -> DataFrame:
    """doc_id, a hash of its text, labels and full of the rows to learn from, in the order of a hash of the id.

    Bounded in rows and in bytes of text; of several texts of an id the one with the least
    hash counts.  full: rows that the low-quality head takes too.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").dropna()
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    # labels of ids that no document has take no place in the sample
    least = texts.groupBy("doc_id").agg(F.min(F.struct("tag", "size")).alias("t")).join(own, "doc_id")
    rows, held, used, in_full = [], 0, 0, 0
    for r in least.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect():
        if held + r.t.size > max_bytes:
            continue
        full = in_full < max_full and used + r.t.size <= max_bytes // 2
        held, used, in_full = held + r.t.size, used + r.t.size * full, in_full + full
        rows.append((r.doc_id, r.t.tag, int(r.quality), int(r.toxic), full))
    return docs.sparkSession.createDataFrame(rows, "doc_id long, tag long, quality int, toxic int, full boolean")


class _Row(NamedTuple):
    """A labelled row as sparse counts: features, and (of rows that are full) their values."""

    doc_id: int
    quality: int
    toxic: int
    full: bool
    f: np.ndarray
    v: np.ndarray


def _sample(docs: DataFrame, labels: DataFrame, max_labelled: int, max_full: int, max_bytes: int) -> DataFrame:
    """Sparse counts of the labelled sample: at most eight bytes per n-gram position of the texts chosen."""
    chosen = _chosen(docs, labels, max_labelled, max_full, max_bytes)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text").join(F.broadcast(chosen), ["doc_id", "tag"])
    texts = texts.dropDuplicates(["doc_id"]).select("doc_id", "quality", "toxic", "full", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value, full = [], [], batch.column(3).to_pylist()
            for block in blocks(batch.column(4)):
                groups = hashed_features(block)
                for i in range(block.rows):
                    own_groups = groups if full[block.first + i] else (groups[0], groups[-1])
                    f, c = np.unique(np.concatenate([g[first[i] : first[i + 1]] for g, first in own_groups]), return_counts=True)
                    group = np.digitize(f, [UNI, UNI + BI, FIRST_START])
                    total = np.maximum(np.bincount(group, c, 4), 1)
                    index.append(f.astype(np.int32).tobytes())
                    value.append((FEATURE_SCALE * c / total[group]).astype(np.float32).tobytes() if full[block.first + i] else b"")
            yield pa.record_batch([*batch.columns[:4], pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=["doc_id", "quality", "toxic", "full", "f", "v"])

    return texts.mapInArrow(run, "doc_id long, quality int, toxic int, full boolean, f binary, v binary")


def _fit(index: np.ndarray, value: np.ndarray, size: np.ndarray, width: int, y: np.ndarray, l2: float = 1e-4, rounds: int = 120, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam steps on the logistic loss with an L2 penalty, classes weighted equally; rows are taken a few at a time.

    Row i has the next size[i] entries of index (below width) and value.
    """
    n = len(y)
    cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + 1, 1 << 18), "left").tolist() + [n]
    start = np.r_[0, np.cumsum(size)]
    chunks = []
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            at = slice(start[a], start[b])
            chunks.append((slice(a, b), index[at], value[at], np.repeat(np.arange(b - a, dtype=np.int32), size[a:b])))
    w, bias = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n
    for t in range(1, rounds + 1):
        full = np.append(l2 * w, 0.0)
        for rows, f, x, row in chunks:
            z = np.bincount(row, x * w[f], rows.stop - rows.start) + bias
            g = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows])
            full[:-1] += np.bincount(f, x * g[row], width)
            full[-1] += g.sum()
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full * full
        move = rate * (1 - (t - 1) / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, bias = w - move[:-1], bias - float(move[-1])
    return w.astype(np.float32), bias


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with the usual smoothed targets."""
    up, down = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -2, 2), b - np.clip(d[1], -2, 2)
    return max(float(a), 1e-3), float(b)


def train_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_full: int = MAX_FULL, max_bytes: int = MAX_BYTES) -> dict[str, Head]:
    """The two calibrated heads; a fifth of the sample, by a hash of the id, is held out for calibration.

    One task gathers the bounded sample and fits both; the driver gets their weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[_Row] = []
        for batch in batches:
            for d, q, t, full, f, v in zip(*(batch.column(k) for k in range(6))):
                rows.append(_Row(d.as_py(), q.as_py(), t.as_py(), full.as_py(), np.frombuffer(f.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32)))
        rows.sort(key=lambda r: r.doc_id)
        for name, head in _heads().items():
            own = [r for r in rows if r.full] if head.by_frequency else rows
            if own:
                _train_head(head, own, np.array([r.quality == 0 if name == "low" else r.toxic == 1 for r in own], float))
            yield pa.record_batch([pa.array([name]), pa.array([pickle.dumps(head)], pa.binary())], names=["name", "head"])
        give_back()

    trained = _sample(docs, labels, max_labelled, max_full, max_bytes).repartition(1).mapInArrow(run, "name string, head binary").collect()
    return _heads() | {r.name: pickle.loads(r.head) for r in trained}


def _heads() -> dict[str, Head]:
    return {"low": Head(), "toxic": Head(by_frequency=False)}


def _train_head(head: Head, rows: list, y: np.ndarray) -> None:
    """Fits and calibrates one head in place; leaves it as it is if a class is missing."""
    held = mix(np.array([r.doc_id for r in rows]).astype(np.uint64)) % np.uint64(5) == 4
    if min(y[~held].sum(), (1 - y[~held]).sum()) < 2:
        return
    parts = [r.f for r in rows]
    place = np.arange(DIM)
    if head.by_frequency:
        seen = np.zeros(DIM, np.int32)
        for f in parts:
            seen[f] += 1
        useful = (seen >= 3) & (place < FIRST_START)
    else:
        useful = _telling(parts, y, ~held) & ((place < UNI) | (place >= FIRST_START))
    if not useful.any():
        return
    # one copy of the entries that are used, fitted rows first
    order = np.argsort(held, kind="stable")
    size = np.array([int(useful[parts[i]].sum()) for i in order])
    start = np.r_[0, np.cumsum(size)]
    narrow = (np.cumsum(useful) - 1).astype(np.int32)
    index, value = np.empty(start[-1], np.int32), np.ones(start[-1], np.float32)
    for k, i in enumerate(order):
        own = useful[parts[i]]
        index[start[k] : start[k + 1]] = narrow[parts[i][own]]
        if head.by_frequency:
            value[start[k] : start[k + 1]] = rows[i].v[own]
    fit = order[: int((~held).sum())]
    last = start[len(fit)]
    weights, head.bias = _fit(index[:last], value[:last], size[: len(fit)], int(useful.sum()), y[fit])
    head.weights[useful] = weights
    z = np.empty(len(rows))
    for k, i in enumerate(order):
        z[i] = float(value[start[k] : start[k + 1]] @ weights[index[start[k] : start[k + 1]]]) + head.bias
    enough = min(y[held].sum(), (1 - y[held]).sum()) >= 2
    head.slope, head.shift = _platt(z[held] if enough else z, y[held] if enough else y)


def _telling(parts: list[np.ndarray], y: np.ndarray, fit: np.ndarray, least: int = 4, deviations: float = 6.0) -> np.ndarray:
    """Features in at least ``least`` positive rows, and in so many deviations more than chance has it."""
    share = y[fit].mean()
    up, every = np.zeros(DIM), np.zeros(DIM)
    for i in np.flatnonzero(fit):
        every[parts[i]] += 1
        up[parts[i]] += y[i]
    expected = share * every
    return (up >= least) & (up - expected >= deviations * np.sqrt(np.maximum(expected * (1 - share), 1e-9)))


SCORE_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_low double, p_toxic double"


def _score(column: pa.Array, heads: dict[str, Head], limits: tuple[float, float]) -> dict[str, np.ndarray]:
    parts = []
    for block in blocks(column):
        own = base_counts(block)
        groups = hashed_features(block)
        own["p_low"] = heads["low"].probability(heads["low"].logits([groups[0], groups[1], _joined(groups[2:4])]))
        own["p_toxic"] = heads["toxic"].probability(heads["toxic"].logits(groups))
        own["base_failed"] = (own["n_words"] < MIN_WORDS) | (100 * own["n_repeat_words"] > MAX_REPEAT_PERCENT * own["n_words"])
        own["kept"] = ~own["base_failed"] & (own["p_low"] < limits[0]) & (own["p_toxic"] < limits[1])
        parts.append(own)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def _joined(groups: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several groups of n-grams as one, row by row."""
    rows = [np.repeat(np.arange(len(first) - 1), np.diff(first)) for _, first in groups]
    order = np.argsort(np.concatenate(rows), kind="stable")
    first = np.sum([f for _, f in groups], axis=0)
    return np.concatenate([f for f, _ in groups])[order], first


def score_quality(docs: DataFrame, heads: dict[str, Head], *, low_limit: float = LOW_QUALITY_LIMIT, toxic_limit: float = TOXIC_LIMIT) -> DataFrame:
    """Per document row: the base counts, the calibrated probabilities and the verdict."""
    sent = docs.sparkSession.sparkContext.broadcast(heads)
    limits = (low_limit, toxic_limit)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [x.split()[0] for x in SCORE_SCHEMA.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = _score(batch.column(1), sent.value, limits)
                yield pa.record_batch([batch.column(0), *(pa.array(got[k]) for k in names)], names=["doc_id", *names])

    return narrow.mapInArrow(run, SCORE_SCHEMA)


def count_base(docs: DataFrame) -> DataFrame:
    """Per document row the base counts and whether it fails the base rules, without a model."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [base_counts(block) for block in blocks(batch.column(1))]
            if parts:
                yield pa.record_batch([batch.column(0), *(pa.array(np.concatenate([p[k] for p in parts])) for k in names)], names=["doc_id", *names])

    counted = narrow.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def keep_quality(docs: DataFrame, heads: dict[str, Head], *, low_limit: float = LOW_QUALITY_LIMIT, toxic_limit: float = TOXIC_LIMIT) -> DataFrame:
    """The rows that :func:`score_quality` keeps, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(heads)
    limits = (low_limit, toxic_limit)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_score(batch.column(at), sent.value, limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)
