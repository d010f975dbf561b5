"""Mixing against a plain version: cells, raked weights, probabilities and sampled documents."""

import random
import re
import struct
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from folioscope.llm import mixing, queries


def plain_topic(text):
    t = text or ""
    size, lines = max(1, len(t)), t.count("\n") + 1
    if len(re.findall(r"[{}();=<>\[\]]", t)) * 25 >= size:
        return "code"
    if len(re.findall(r"^[^\n|\t]*[|\t][^\n]*$", t, re.M)) * 2 >= lines:
        return "table"
    if lines >= 3 and len(re.findall(r"^[ \t]*(?:[-*•]|[0-9]{1,3}[.)])[ \t]", t, re.M)) * 2 >= lines:
        return "list"
    if len(re.findall(r"[0-9]", t)) * 5 >= size:
        return "figures"
    if sum(c.isupper() for c in t) * 3 >= size:
        return "capitals"
    return "prose"


def plain_goal(sums, wanted, power):
    total = sum(sums.values())
    live = {k: v for k, v in sums.items() if v}
    if wanted is None:
        raw = {k: v**power for k, v in live.items()}
        return {k: v / sum(raw.values()) for k, v in raw.items()}
    known = [k for k in live if k in wanted]
    if not known:
        return {k: v / total for k, v in live.items()}
    room = sum(live[k] for k in known) / total
    return {k: room * wanted[k] / sum(wanted[x] for x in known) if k in wanted else v / total for k, v in live.items()}


def plain_mix(docs, targets, budget, seed):
    """id -> (weight, probability, sampled), by dictionaries and bisection."""
    cell = {d.doc_id: (d.source, d.lang, plain_topic(d.text)) for d in docs}
    words = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    tokens = defaultdict(float)
    for k, c in cell.items():
        tokens[c] += words[k]
    total = sum(tokens.values())
    share = {c: t / total for c, t in tokens.items()}
    goals = []
    for m, name in enumerate(mixing.MARGINS):
        sums = defaultdict(float)
        for c, t in tokens.items():
            sums[c[m]] += t
        goals.append(plain_goal(sums, targets.get(name), mixing.TEMPER[name]))
    for _ in range(400):
        for m, goal in enumerate(goals):
            sums = defaultdict(float)
            for c, s in share.items():
                sums[c[m]] += s
            share = {c: s * goal.get(c[m], 0) / sums[c[m]] if sums[c[m]] else s for c, s in share.items()}
    weight = {c: share[c] * total / t if t else 1.0 for c, t in tokens.items()}
    lo, hi = 0.0, 2.0**60
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(t * min(1, mid * weight[c]) for c, t in tokens.items()) < budget * total else (lo, mid)
    out = {}
    for k, c in cell.items():
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", k), h)
        p = min(1, hi * weight[c])
        out[k] = weight[c], p, (h >> 11) / 2**53 < p
    return out


@pytest.mark.parametrize("max_cells", [mixing.MAX_CELLS, 3])
def test_query_against_plain_version(spark, sf_dir, monkeypatch, max_cells):
    """Both ways, at their default rounds: weights and probabilities to 1e-6, and the same documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    want = plain_mix(docs.collect(), mixing.TARGETS, mixing.BUDGET, 17)
    got = mixing.mix_sources(docs, targets=mixing.TARGETS, max_cells=max_cells).collect()
    assert {r.doc_id for r in got} == want.keys()
    for r in got:
        assert np.allclose((r.weight, r.probability), want[r.doc_id][:2], rtol=1e-6, atol=1e-6)
        assert r.sampled == want[r.doc_id][2]
    if max_cells == mixing.MAX_CELLS:
        assert sorted(map(tuple, queries.op2_mixing(spark, sf_dir).select("doc_id", "sampled").collect())) == sorted((k, v[2]) for k, v in want.items())


def test_both_ways_on_skewed_cells(spark):
    """300 sparse cells, most sources in one language: both ways agree at default rounds."""
    rng = random.Random(3)
    cells = {}
    for s in range(120):
        for _ in range(3):
            cells[f"s{s}", rng.choice(["en", "en", "de", None]) if s % 3 else "fr", rng.choice(["prose", "prose", "list", "code"])] = rng.choice([1, 10, 100, 5000])
    rows = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    for targets in ({"lang": {"en": 0.5, "de": 0.3}, "source": {"s1": 0.5, "s2": 0.1}},):
        near = {r[:3]: r[3:] for r in mixing._on_driver(rows.collect(), targets, 0.6)}
        far = {(r.source, r.lang, r.topic): (r.weight, r.probability) for r in mixing._distributed(rows, targets, 0.6).collect()}
        assert near.keys() == far.keys()
        assert max(abs(a - b) for k in near for a, b in zip(near[k], far[k])) < 1e-6


def composed(kind, rng):
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(1, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    many = rng.randint(4, 30)
    if kind == "code":
        return "\n".join(f"    {word()} = {word()}({word()}, {rng.randint(0, 99)}); if ({word()} > 1) {{ {word()}(); }}" for _ in range(many))
    if kind == "table":
        return line(5) + "\n" + "\n".join(f"{word()} | {word()} | {rng.randint(0, 9)}" for _ in range(many))
    if kind == "list":
        return line(6) + "\n" + "\n".join(f"{rng.choice(['- ', '* ', '1. '])}{line(rng.randint(1, 9))}" for _ in range(many))
    if kind == "figures":
        return " ".join(f"{rng.random() * 1000:.4f}" for _ in range(many))
    if kind == "capitals":
        return line(many * 4).upper()
    return "\n".join(f"{line(rng.randint(8, 60)).capitalize()}. It was {rng.randint(1900, 2020)}; {word()} (or {word()}) said so." for _ in range(rng.randint(1, 9)))


def test_topic_of_composed_texts(spark):
    rng = random.Random(12)
    rows = [(kind, composed(kind, rng)) for kind in ("code", "table", "list", "figures", "capitals", "prose") for _ in range(100)]
    got = spark.createDataFrame(rows, "kind string, text string").select("kind", "text", mixing.topic().alias("topic")).collect()
    assert sum(r.kind == r.topic for r in got) / len(got) > 0.95
    assert all(r.topic == plain_topic(r.text) for r in got)


def test_rows_without_an_id(spark):
    rows = [(None, f"text {i}", "en", "s") for i in range(400)] + [(5, "text", "en", "s")] * 3
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), budget=0.5).collect()
    taken = sum(r.sampled for r in got if r.doc_id is None)
    assert 140 < taken < 260 and len({r.sampled for r in got if r.doc_id == 5}) == 1


@pytest.mark.parametrize("name", ["quality_base", "mixing_cells", "op3_chat_format", "op4_decontamination"])
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
