"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed byte 1- to 4-grams (A-Z lower-cased);
a linear softmax over that mean gives the language.  Embeddings and softmax are trained
together by stochastic gradient descent in numpy.  A temperature is fitted on rows kept
back from training; the rejection threshold is set on them so that at most
``rejected_right`` of the right answers are rejected.

Scale: training takes at most ``max_rows`` rows (smallest hash of their id), reduced to
sparse counts on the executors.  Since the model is linear after the mean, embeddings and
softmax are folded into one table (buckets x languages), and prediction is one pass in
Arrow batches over whole texts, without a shuffle.

Defined cases: null text or text without a letter gives ``und`` with score 0; with no rows
to learn from every text is ``und``; ties go to the first language in sorted order;
repeated rows each give a row; other columns, whatever their names, pass through where they are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import LOWER, Block, blocks, byte_class, byte_ngrams, mix, ngram_rows

MAX_ROWS = 3000
BUCKETS = 1 << 15
DIM = 16
ORDERS = (1, 2, 3, 4)
UNDETERMINED = "und"
_ASCII_LETTERS = byte_class(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))


def _grams(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    data = LOWER[block.data]
    for n in ORDERS:
        hashes = (mix(byte_ngrams(data, n) + np.uint64(n << 40)) >> np.uint64(64 - 15)).astype(np.int32)
        yield hashes, *ngram_rows(block, n)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, block: Block) -> np.ndarray:
        k = len(self.languages)
        logits, count = np.zeros((block.rows, k)), np.zeros(block.rows)
        columns = [np.ascontiguousarray(self.table[:, j]) for j in range(k)]
        for hashes, lo, hi in _grams(block):
            lo, hi = np.minimum(lo, len(hashes)), np.minimum(hi, len(hashes))
            count += hi - lo
            for j in range(k):
                total = np.zeros(len(hashes) + 1)
                np.cumsum(columns[j][hashes], out=total[1:])
                logits[:, j] += total[hi] - total[lo]
        logits = (logits / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _sample(docs: DataFrame, max_rows: int) -> list:
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = rows.join(F.broadcast(chosen), "doc_id")
    # of several rows of an id the same one in every run
    texts = texts.groupBy("doc_id").agg(F.min_by(F.struct("lang", "text"), F.struct(F.xxhash64("lang", "text"), "lang", "text")).alias("r")).select("doc_id", "r.lang", "r.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, count = [], []
            for block in blocks(batch.column(2)):
                parts = list(_grams(block))
                for i in range(block.rows):
                    f, c = np.unique(np.concatenate([h[min(a[i], len(h)) : min(b[i], len(h))] for h, a, b in parts]), return_counts=True)
                    index.append(f.astype(np.int32).tobytes())
                    count.append(c.astype(np.int32).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(index, pa.binary()), pa.array(count, pa.binary())], names=["doc_id", "lang", "f", "c"])

    return sorted(texts.mapInArrow(run, "doc_id long, lang string, f binary, c binary").collect(), key=lambda r: r.doc_id)


def train_language_model(docs: DataFrame, *, max_rows: int = MAX_ROWS, epochs: int = 6, least_steps: int = 8000, rate: float = 4.0, rejected_right: float = 0.01, seed: int = 7) -> LanguageModel:
    """Learns from doc_id, text and lang of the rows given; the caller leaves out what must not be seen."""
    rows = _sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), max_rows)
    languages = sorted({r.lang for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    x = [(np.frombuffer(r.f, np.int32), np.frombuffer(r.c, np.int32) / max(1, np.frombuffer(r.c, np.int32).sum())) for r in rows]
    y = np.array([languages.index(r.lang) for r in rows])
    k = len(languages)
    back = mix(np.array([r.doc_id for r in rows]).astype(np.uint64)) % np.uint64(8) == 7 if len(rows) >= 40 else np.zeros(len(rows), bool)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft, bias = rng.normal(0, 0.1, (DIM, k)), np.zeros(k)
    fit = np.flatnonzero(~back)
    epochs = max(epochs, -(-least_steps // max(1, len(fit))))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            f, v = x[i]
            if not len(f):
                continue
            mean = v @ embed[f]
            z = mean @ soft + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            down = soft @ g
            soft -= step * 0.1 * np.outer(mean, g)
            bias -= step * 0.01 * g
            embed[f] -= step * np.outer(v, down)
    table = embed @ soft
    logits = np.array([v @ table[f] + bias for f, v in x])
    own = np.flatnonzero(back) if back.any() else np.arange(len(rows))

    def loss(t: float) -> float:
        z = logits[own] / t
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(own)), y[own]]))

    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 41))
    temperature = float(min(grid, key=loss))
    z = logits[own] / temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[own]])
    threshold = float(right[int(rejected_right * len(right))]) if len(right) else 0.0
    return LanguageModel(languages, table.astype(np.float32), bias, temperature, threshold)


def has_letter(block: Block) -> np.ndarray:
    out = block.sums(_ASCII_LETTERS[block.data]) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in block.text(i).decode("utf-8", "replace"))
    return out


def predict_language(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: lang_pred, score and accepted (score at or over the calibrated threshold)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).cast("string").alias("text"))
    names_kept = narrow.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            names, scores = [], []
            for block in blocks(batch.column(batch.num_columns - 1)):
                known = has_letter(block) if m.languages else np.zeros(block.rows, bool)
                if m.languages:
                    p = m.probabilities(block)
                    best = p.argmax(axis=1)
                    names += [m.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known)]
                    scores.append(np.where(known, p[np.arange(len(best)), best], 0.0))
                else:
                    names += [UNDETERMINED] * block.rows
                    scores.append(np.zeros(block.rows))
            score = np.concatenate(scores)
            accepted = (score >= m.threshold) & np.array([n != UNDETERMINED for n in names])
            yield pa.record_batch([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score), pa.array(accepted)], names=[*names_kept, "lang_pred", "score", "accepted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.drop("text").schema)
    return narrow.mapInArrow(run, f"{kinds}, lang_pred string, score double, accepted boolean")
