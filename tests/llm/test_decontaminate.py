"""Decontamination with many automata, odd items and columns, against the one-pass way and a plain version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text, items):
    """(words, hit words, items) by comparing every window."""
    lower = lambda t: re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = lower(text), set(), set()
    for item, t in items:
        own = lower(t)
        n = min(10, len(own))
        if not n:
            continue
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found |= {str(item)} - {"None"}  # hit, but not listed
    return len(words), len(hit), sorted(found)


def planted(rng):
    say = lambda n: [rng.choice("abcdefghijk") + str(rng.randrange(4)) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([3, 8, 10, 14, 40])))) for i in range(60)] + [(None, "items without an id match like others here now ever x"), (70, None), (71, " .,"), (72, "Ünï wörd")]
    docs = []
    for i in range(120):
        words = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            words += (rng.choice(items[:60])[1]).split()[: rng.randint(5, 40)] + say(rng.randint(0, 9))
        docs.append((i, " ".join(words)))
    docs += [(200, None), (201, ""), (202, items[60][1]), (203, "says ünï wörd"), (204, "Ünï wörd"), (5, docs[5][1]), (None, docs[7][1]), (None, None)]
    return docs, items


def test_many_automata(spark):
    docs, items = planted(random.Random(5))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("key", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = sorted((str(d), *map(str, plain(t, items))) for d, t in docs)
    for most in (decontaminate.MAX_ITEM_WORDS, 150):
        got = decontaminate.find_contamination(frame, bench, max_item_words=most).collect()
        assert sorted((str(r.doc_id), str(r.n_words), str(r.n_hit), str(r["items"])) for r in got) == texts
    one = decontaminate.remove_contamination(frame, bench).collect()
    many = decontaminate.remove_contamination(frame, bench, max_item_words=300)
    assert many.columns == frame.columns
    assert sorted(map(str, one)) == sorted(map(str, many.collect()))
    assert all(plain(r.text, items)[1] == 0 for r in one)


@pytest.mark.parametrize("most", [200_000, 12])
def test_items_without_an_id_are_hit_but_not_listed(spark, most):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, text), (2, "nothing of it"), (3, text + " and more"), (4, "tiny item")], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (5, text), (None, "tiny item")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.find_contamination(docs, items, max_item_words=most).collect()}
    assert got == {1: (11, ["5"]), 2: (0, []), 3: (11, ["5"]), 4: (2, [])}
