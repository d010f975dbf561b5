"""The parity-sketch join against all pairs, and the bounds that it rests on."""

import random
import re

import numpy as np
import pytest

from folioscope.llm import parity_join, queries
from folioscope.llm.simhash import connected_components

SCHEMA = "doc_id long, text string"


def shingles(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((-1 if d is None else d, len(sets[i]), -1 if (c := least.get(root(i))) is None else c) for i, (d, _) in enumerate(rows))


def got(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in frame.collect())


def planted(rng, groups=14):
    """Near copies on both sides of the limit, of many sizes; boilerplate that most texts share; chains of small edits."""
    letters = "abcdefghijklmnop"
    word = lambda: "".join(rng.choices(letters, k=4))
    shared = [word() for _ in range(70)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice((4, 6, 9, 14, 25, 40, 80, 160, 400)))]
        if rng.random() < 0.6:
            base = shared + base
        for _ in range(rng.randrange(2, 7)):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, len(base) // 60, len(base) // 40, len(base) // 25))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [word()][: rng.randrange(2)]
            texts.append(" ".join(copy))
    chain = [word() for _ in range(120)]
    for _ in range(8):
        chain[rng.randrange(120)] = word()
        texts.append(" ".join(chain))
    return texts


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(queries.op12_ngram_jaccard_join(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("seed, blocks", [(1, {}), (2, {"block_sets": 3, "block_shingles": 500}), (3, {"block_sets": 5})])
def test_planted_against_brute_force(spark, monkeypatch, seed, blocks):
    rng = random.Random(seed)
    texts = planted(rng)
    texts += rng.sample(texts, 10) + [None, "", " \n", "one", "One", "two words", "a b c", "a b c d", "a b c d", "x y " * 300, "x y " * 200]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[5]), (None, texts[0]), (None, "nobody else says this at all"), (None, None)]
    if seed == 3:
        monkeypatch.setattr(parity_join, "MANY", 3)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(parity_join.similar_documents(frame, **blocks)) == brute(rows)


def test_another_limit(spark):
    rng = random.Random(9)
    rows = list(enumerate(planted(rng, 10)))
    assert got(parity_join.similar_documents(spark.createDataFrame(rows, SCHEMA), percent=70)) == brute(rows, 70)


def test_empty_table_and_clashing_names(spark):
    assert parity_join.similar_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    wide = spark.createDataFrame([(1, "A b c d e", "k", 5), (2, "a B c d e", "t", 6), (4, "else", "t", 6)], "id int, body string, key string, n int")
    assert got(parity_join.similar_documents(wide, id_col="id", text_col="body")) == [(1, 2, 1), (2, 2, 1), (4, 1, 4)]


def test_long_texts(spark):
    rng = np.random.default_rng(4)
    long = " ".join(map(str, rng.integers(0, 10**6, 160_000)))
    rows = [(1, long), (2, long + " more"), (3, long[: len(long) // 2])]
    assert [c for *_, c in got(parity_join.similar_documents(spark.createDataFrame(rows, SCHEMA)))] == [1, 1, 3]


def random_set(rng, n):
    return np.unique(rng.integers(0, 2**63, n).astype(np.uint64))


def test_pieces_keep_the_pigeonhole_bound():
    """A pair at its greatest difference shares as many keys as each of its sets is told to need."""
    rng = np.random.default_rng(7)
    edges = parity_join.bands()
    for n in (6, 7, 11, 12, 13, 30, 77, 200, 555, 2000):
        for _ in range(20):
            a = random_set(rng, n)
            gone = int(rng.integers(0, n * 15 // 100 + 1))
            new = int((n - gone) // 0.85) - n
            b = np.unique(np.r_[rng.permutation(a)[gone:], random_set(rng, max(0, min(new, n)))])
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both):
                continue
            small, large = sorted((a, b), key=len)
            band = int(np.searchsorted(edges, len(small), "right")) - 1
            x, need_x = parity_join.pieces(small, band)
            y, need_y = parity_join.pieces(large, band)
            if need_x:
                assert len(np.intersect1d(x, y)) >= max(1, min(need_x, need_y))
                assert len(large) < edges[band + 2]


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(8)
    base = random_set(rng, 400)
    sets = [np.unique(np.r_[base[: rng.integers(1, 400)], random_set(rng, int(rng.integers(1, 900)))]) for _ in range(40)]
    s = parity_join.sketches(sets)
    for i in range(40):
        for j in range(i):
            assert int(np.bitwise_count(s[i] ^ s[j]).sum()) <= len(np.setxor1d(sets[i], sets[j]))


def join_rows(spark, run):
    """The rows that all joins of the queries of a call have made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    total = 0
    executions = store.executionsList()
    for i in range(before, executions.size()):
        one = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(one), store.planGraph(one).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name():
                metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
                found = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                total += sum(int(v.get().replace(",", "")) for v in found if v.isDefined())
    return total


def test_ties_of_a_large_group_are_looked_up_once(spark):
    """A group of 1,500 sets with some twenty ties each, as many keys of a few sets give them."""
    rng = random.Random(5)
    nodes = rng.sample(range(10**9), 1500)
    ties = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(15_000)})
    frame = spark.createDataFrame(ties, "a long, b long")
    roots = []
    made = join_rows(spark, lambda: roots.extend(connected_components(frame).collect()))
    assert {r.root for r in roots} == {min(x for t in ties for x in t)} and len(roots) == len({x for t in ties for x in t})
    assert made < 3 * len(ties)
