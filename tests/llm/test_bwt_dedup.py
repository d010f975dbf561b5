"""Parts of the repeat search: segments of long texts, streamed groups, frequent anchors, many equal rows."""

import random
import time

import numpy as np
import pyarrow as pa

from folioscope.llm import bwt_dedup


def test_segments_give_the_anchors_of_the_whole_text():
    rng = np.random.default_rng(4)
    for n in (0, 19, 20, 21, 700, 3000):
        data = rng.integers(97, 99, n, dtype=np.uint8)
        data[n // 2 :] = data[: n - n // 2]
        want = bwt_dedup.anchors_of(data, 20, 7)
        for segment in (1, 13, 64, 500):
            got = bwt_dedup.anchors_of(data, 20, 7, segment)
            assert all(np.array_equal(a, b) for a, b in zip(want, got))


def test_streamed_groups_are_cut_anywhere():
    """Each place is told once, whatever the batches: repeats of a reach, and one that stands for each reach of an anchor with several."""
    rng = random.Random(3)
    rows = sorted((rng.randrange(12), rng.randrange(4), i) for i in range(300))
    want_repeats = {i for a, r, i in rows if sum((x, y) == (a, r) for x, y, _ in rows) > 1}
    want_stands = {(a, r) for a, r, _ in rows if len({y for x, y, _ in rows if x == a}) > 1}
    for size in (1, 2, 7, 300):
        batches = [pa.record_batch([*(pa.array([x[k] for x in rows[lo : lo + size]], pa.int64()) for k in range(3)), pa.array([0] * len(rows[lo : lo + size]), pa.int32())], names=["anchor", "reach", "pos", "state"]) for lo in range(0, 300, size)]
        repeats, stands = [], []
        for batch, rep, sta in bwt_dedup.group_stream(iter(batches)):
            repeats += batch.column("pos").filter(pa.array(rep)).to_pylist()
            stands += [(a, r) for a, r, s in zip(batch.column("anchor").to_pylist(), batch.column("reach").to_pylist(), sta) if s]
        assert sorted(repeats) == sorted(want_repeats) and sorted(stands) == sorted(want_stands)


def test_frequent_anchors_are_dealt_by_reach(spark):
    from test_llm_operators import check_repeats

    rng = random.Random(11)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = say(40)
    rows = [(i, say(30) + line + (say(30) if i % 3 else "the same end in every third one")) for i in range(60)] + [(60, None), (None, line), (1, "x")]
    check_repeats(spark, rows, 30, 10, sample=1.0, hot_share=1e-6, hot_seen=2)
    check_repeats(spark, rows, 30, 10, sample=1.0, hot_share=1e-6, hot_seen=2, hot_anchor=3)


def test_many_equal_rows_are_linear(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    docs = spark.createDataFrame([(7, text)] * 5000 + [(None, text)] * 5000, "doc_id long, text string")
    began = time.time()
    got = bwt_dedup.remove_repeats(docs).selectExpr("doc_id", "n_bytes", "length(kept) AS k").groupBy("doc_id", "n_bytes", "k").count().collect()
    assert sorted(map(str, map(tuple, got))) == sorted(["(7, 1500, 0, 5000)", "(None, 1500, 0, 5000)"])
    assert time.time() - began < 120
