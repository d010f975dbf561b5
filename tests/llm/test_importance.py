"""Importance resampling against a plain version that counts with dictionaries."""

import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from folioscope.llm import importance, queries

SCHEMA = "doc_id long, text string"


def features(text, runs=1):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, buckets=10_000, runs=1, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text, runs)[1]))
    for text in target:
        t.update(map(bucket, features(text, runs)[1]))
    own, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (own + buckets) / ((s[b] + 1) * (wanted + buckets))))
    rows = []
    for d, text in docs:
        words, found = features(text, runs)
        weight = sum(gain(bucket(f)) for f in found)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, words, len(found), weight, score, None])
    may = sorted((r for r in rows if r[4] is not None and r[1] >= least), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[5] = k
    return rows


def key(row):
    return tuple(-(10**9) if x is None else x for x in row)


def test_query_against_plain(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted(key(r) for r in queries.op13_importance_resampling(spark, sf_dir).collect())
    assert got == sorted(key([r[0], *r[2:]]) for r in plain(docs, target))


@pytest.mark.parametrize("options", [{}, {"runs": 3, "buckets": 64}, {"least_words": 1, "percent": 100}, {"percent": 0}])
def test_edges_against_plain(spark, options):
    rng = random.Random(5)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1", "9", "日本", "it's", "a\x00b"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "...,, !"), (None, "beta " * 30), (None, None), (203, "beta " * 30), (203, "beta " * 30), (203, "Alpha " * 25), (204, "été " * 50_000)]
    target = ["alpha beta beta", None, "", "日本 x1 x1"]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    got = importance.resample(frame, spark.createDataFrame([(1, t) for t in target], "item_id long, text string"), **options).collect()
    named = {"least_words": "least", "percent": "percent", "runs": "runs", "buckets": "buckets"}
    want = plain(docs, target, **{named[k]: v for k, v in options.items()})
    assert sorted(key(r) for r in got) == sorted(map(key, want))


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(i, f"word{i} " * 25) for i in range(20)], SCHEMA)
    assert importance.resample(none, some).collect() == []
    got = importance.resample(some, none).collect()
    assert sorted(key(r) for r in got) == sorted(map(key, plain([(i, f"word{i} " * 25) for i in range(20)], [])))
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


def test_drawn_rows_keep_their_columns(spark):
    rows = [(i, f"word{i} " * 25, "s", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string, score int")
    drawn = importance.draw(docs, docs.select("text").limit(3)).collect()
    assert len(drawn) == 4 and all(r["rank"] == "s" and r.score == r.doc_id for r in drawn)


def test_blocks_hold_the_whole_matrix(spark):
    docs = [(i, "tag " * i) for i in range(50)]
    matrix = importance.count_matrix(spark.createDataFrame(docs, SCHEMA).repartition(3), buckets=16)
    rows = {d: (n, sum(b.counts[lo:hi])) for b in matrix.collect() for d, n, lo, hi in zip(b.ids, b.n_words, b.row_ptr, b.row_ptr[1:])}
    assert rows == {i: (i, i) for i in range(50)}
    assert importance.column_sums(matrix, 16).sum() == sum(range(50))


def test_matrix_is_written_in_small_row_groups(spark, tmp_path, monkeypatch):
    """A reader decodes a row group at a time, so a file of many large blocks has many of them."""
    kept = []
    monkeypatch.setattr(importance, "GROUP_BYTES", 1 << 14, raising=False)
    monkeypatch.setattr(importance, "drop_folder", lambda _, folder: kept.append(folder))
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(60_000))) for i in range(12)]
    assert len(importance.resample(spark.createDataFrame(docs, SCHEMA).coalesce(1), spark.createDataFrame(docs[:1], SCHEMA)).collect()) == 12
    (folder,) = kept
    sizes = [f.metadata.row_group(k).num_rows for p in glob.glob(f"{folder.removeprefix('file:')}/*.parquet") for f in [pq.ParquetFile(p)] for k in range(f.num_row_groups)]
    assert sum(sizes) >= 12 and max(sizes) <= importance.GROUP_CHECK
