"""Language predictions against a plain version of the model, and what the calibrated threshold rejects."""

import math
import random

import pyarrow as pa

from folioscope.llm import langid
from folioscope.llm.shared import blocks

MASK = (1 << 64) - 1


def plain_mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def plain_probabilities(model, text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    z, count = [0.0] * len(model.languages), 0
    for n in langid.ORDERS:
        for i in range(len(data) - n + 1):
            bucket = plain_mix(int.from_bytes(data[i : i + n], "little") + (n << 40) & MASK) >> 49
            z = [a + float(w) for a, w in zip(z, model.table[bucket])]
            count += 1
    z = [(a / max(count, 1) + float(b)) / model.temperature for a, b in zip(z, model.bias)]
    e = [math.exp(a - max(z)) for a in z]
    return [a / sum(e) for a in e]


def test_predictions_and_rejection(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    model = langid.train_language_model(docs.filter("NOT held_out").select("doc_id", "text", "lang"))
    rows = docs.collect()
    got = {r.doc_id: r for r in langid.predict_language(docs, model).collect()}
    for r in rows[:25]:
        text = (r.text or "")[:4000]
        p = plain_probabilities(model, text)
        mine = next(blocks(pa.array([text])))
        assert max(abs(a - b) for a, b in zip(p, model.probabilities(mine)[0])) < 1e-4
        if r.text and len(r.text) <= 4000 and any(c.isalpha() for c in text):
            assert got[r.doc_id].lang_pred == model.languages[max(range(len(p)), key=p.__getitem__)] and abs(got[r.doc_id].score - max(p)) < 1e-4
    told = [got[r.doc_id] for r in rows if r.held_out and r.lang and r.text and got[r.doc_id].lang_pred == r.lang]
    assert sum(not r.accepted for r in told) <= max(2, 0.1 * len(told))  # right answers are hardly ever rejected
    rng = random.Random(5)
    noise = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(60)) for _ in range(50)]
    odd = spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string")
    scores = [r.score for r in langid.predict_language(odd, model).collect()]
    assert sum(scores) / len(scores) < sum(r.score for r in told) / len(told)
