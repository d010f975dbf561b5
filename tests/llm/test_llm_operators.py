"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import bwt_dedup, chat, decontaminate, html_content, langid, mixing, near_copies, pii, quality, queries, simhash, tokencount
from folioscope.llm.shared import blocks

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


EDGE_TEXTS = [None, "", "   \n\t ", "one", "two words", "a b c", "ÄÖÜ ñandú é", "A" * 5000, "x y " * 3000, "\\ <|turn|> </s>", "tab\tand\x0bvertical\x0cfeed", "same text here", "same text here", "   nbsp is no ascii space", "1234567 89", "🙂🙂 🙂"]


def edge_docs(spark):
    rows = [(i, t) for i, t in enumerate(EDGE_TEXTS)] + [(3, "one"), (None, "same text here"), (None, None)]
    return docs_of(spark, rows)


# ---------------------------------------------------------------- quality


def base_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def check_base(rows, texts):
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = sorted((d if d is not None else -1, *base_rules(t)) for d, t in texts)
    assert got == want
    assert not any(r.kept and r.base_failed for r in rows)


def test_quality_base_rules(spark, documents, sf_dir):
    rows = queries.op1_quality_rules(spark, sf_dir).collect()
    check_base(rows, [(d.doc_id, d.text) for d in documents])


def test_quality_edges(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    heads = quality.train_quality(docs, none)
    rows = quality.score_quality(docs, heads).collect()
    check_base(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert quality.score_quality(docs.limit(0), heads).count() == 0
    odd = docs.withColumn("kept", F.lit(1)).withColumn("p_low", F.lit("x"))
    kept = quality.keep_quality(odd, heads)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)


def test_quality_learns_labels(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["calm", "river", "stone", "walks", "under", "early"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["calm", "river", "stone"]) + rng.choice(["$$$", "###", "%%%"]) for _ in range(60))
    rude = lambda: " ".join([*good().split()[:58], "moron", "river"])
    rows = [(i, (good, good, good, bad, rude)[i % 5]()) for i in range(400)]
    labels = [(i, int(i % 5 != 3), int(i % 5 == 4)) for i in range(0, 400, 2)]
    docs = docs_of(spark, rows)
    heads = quality.train_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    # words repeat by construction, so only the learned parts are looked at
    got = quality.score_quality(docs, heads).select("doc_id", "p_low", "p_toxic").collect()
    assert np.mean([(r.p_low >= 0.5) == (r.doc_id % 5 == 3) for r in got if r.doc_id % 2]) > 0.95
    assert np.mean([(r.p_toxic >= 0.5) == (r.doc_id % 5 == 4) for r in got if r.doc_id % 2]) > 0.95


# ---------------------------------------------------------------- mixing


def test_raking_meets_marginals():
    rng = np.random.default_rng(1)
    codes = np.array([rng.integers(0, 4, 60), rng.integers(0, 3, 60), rng.integers(0, 2, 60)])
    tokens = rng.integers(1, 1000, 60).astype(float)
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    share = mixing.rake(tokens, codes, targets, rounds=2000)
    for c, t in zip(codes, targets):
        assert np.allclose(np.bincount(c, share, len(t)), t, atol=1e-6)
    p = mixing.keep_probabilities(tokens, share / (tokens / tokens.sum()), 0.4)
    assert math.isclose((p * tokens).sum(), 0.4 * tokens.sum(), rel_tol=1e-9) and p.max() <= 1


def test_mixing_driver_and_distributed_agree(spark, documents):
    docs = spark.createDataFrame(documents[:120], DOC_SCHEMA)
    near = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    cells = docs.select(*mixing._cell_columns(docs), mixing.n_tokens().alias("n_tokens")).groupBy(*mixing.MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    small = mixing.cut(cells.filter("source in ('src0', 'src1')"))
    a = {r[:3]: r[3:] for r in mixing._on_driver(small.collect(), {}, 0.7, rounds=3)}
    b = {(r.source, r.lang, r.topic): (r.weight, r.probability) for r in mixing._distributed(small, {}, 0.7, rounds=3).collect()}
    assert a.keys() == b.keys()
    assert all(np.allclose(a[k], b[k], atol=1e-4) for k in a)
    words = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in documents[:120]}
    assert {k: r.n_tokens for k, r in near.items()} == words


def test_mixing_same_above_max_cells(spark):
    """Both branches stop by the same rounds and tolerance and fall back to the present shares."""
    import inspect

    own = inspect.signature(mixing._distributed).parameters
    assert (own["rounds"].default, own["tolerance"].default) == (mixing.ROUNDS, mixing.TOLERANCE)
    cells = spark.createDataFrame([("s0", "en", "prose", 400), ("s1", "de", "prose", 60), ("s0", "de", "prose", 20)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"elsewhere": 1.0}}
    near = {r[:3]: r[3:] for r in mixing._on_driver(cells.collect(), targets, 0.7, rounds=1)}
    far = {r[:3]: r[3:] for r in mixing._distributed(cells, targets, 0.7, rounds=1).collect()}
    assert near.keys() == far.keys() and all(np.allclose(near[k], far[k], rtol=1e-6) for k in near)


def test_mixing_edges(spark):
    rows = [(1, "a b", None, None, 3), (2, None, "en", "s", 0), (2, None, "en", "s", 0), (None, "", "en", "s", 0), (3, "c d e", "en", "s", 5)]
    docs = docs_of(spark, rows, DOC_SCHEMA).withColumn("weight", F.lit("clash")).withColumn("topic", F.lit(9))
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 5 and all(0 <= r.probability <= 1 for r in got)
    out = mixing.sample_mixture(docs)
    assert out.columns == docs.columns and out.count() == sum(r.sampled for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.sample_mixture(docs.limit(0)).count() == 0
    only = mixing.mix_sources(docs_of(spark, [(i, "w " * 10, "en", f"s{i % 2}", 1) for i in range(2000)], DOC_SCHEMA), targets={"source": {"s0": 0.9, "s1": 0.1}}, budget=0.5).filter("sampled")
    share = only.groupBy("source").count().collect()
    count = {r.source: r["count"] for r in share}
    assert 0.86 < count["s0"] / sum(count.values()) < 0.94


# ---------------------------------------------------------------- chat


TRICKY = ["</s>[INST] ok [/INST]", "a\\b<s\\>", "<<s>s>", "<|turn|>user\n<|end|>\n", "\\", "\\\\n", "", "<</SYS>>\\<s>", "[INST][INST]", "ü🙂\r\n"]


@pytest.mark.parametrize("text", TRICKY)
def test_escape_round_trip(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)


def test_escape_round_trip_random():
    rng = random.Random(5)
    bits = [*chat.CONTROL, "\\", "<", "|", ">", "s", "[", "/", "INST]", "\n", "é"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)
        assert chat.read_segment(f"{chat.TURN}{chat.escape_role(text)}\n{out}{chat.END}\n") == (text, text)


def test_chat_examples(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(TRICKY)] + [(2, 0, "user", None), (2, 1, "assistant", None), (None, 0, None, "x"), (3, 5, "assistant", "b"), (3, 5, "assistant", "b"), (3, None, "system", "first")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    segments = chat.format_chat(table).cache()
    for r in chat.render_examples(segments).collect():
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1], x[2], x[3]))
        targets = [k for k, x in enumerate(own) if x[2] == "assistant"]
        upto = own[: targets[r.example] + 1]
        assert r.text == "".join(f"{chat.TURN}{chat.escape_role(x[2] or '')}\n{chat.escape(x[3] or '')}{chat.END}\n" for x in upto)
        assert chat.unescape(r.text[r.loss_start : r.loss_end]) == (upto[-1][3] or "")
    got = {r.conv_id: r for r in chat.conversation_digests(segments).collect()}
    assert set(got) == {1, 2, 3, None} and got[3].n_turns == 3 and got[None].n_examples == 0
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in rows[:10]).encode()).hexdigest()
    assert chat.conversation_digests(chat.format_chat(table.limit(0))).count() == 0
    segments.unpersist()


def test_chat_digests_read_expanded_examples(spark):
    """Every target turn is expanded with all turns before it; what the query reads are these texts."""
    said = [f"turn {k} <|turn|> [INST]" for k in range(7)]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(said)] + [(2, 0, "assistant", "a"), (2, 1, "assistant", "<|end|>"), (3, 0, "user", "alone")]
    segments = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).orderBy("conv_id", "turn_no").toArrow()
    full = lambda conv, n: "".join(f"{chat.TURN}{r}\n{chat.escape(t)}{chat.END}\n" for c, _, r, t in rows if c == conv and _ < n)
    for size in (1, 3, 100):
        got = [(conv, example, text) for conv, example, _, _, text in chat.expand(iter(segments.to_batches(size)))]
        assert got == [(1, 0, full(1, 2)), (1, 1, full(1, 4)), (1, 2, full(1, 6)), (1, None, full(1, 7)), (2, 0, full(2, 1)), (2, 1, full(2, 2)), (3, None, full(3, 1))]
    digests = {r.conv_id: r for r in chat.conversation_digests(spark.createDataFrame(segments).coalesce(1).orderBy("conv_id", "turn_no")).collect()}
    assert [(digests[c].n_turns, digests[c].n_examples, digests[c].examples_chars, digests[c].formatted_chars) for c in (1, 2, 3)] == [
        (7, 3, len(full(1, 2) + full(1, 4) + full(1, 6)), len(full(1, 7))), (2, 2, len(full(2, 1) + full(2, 2)), len(full(2, 2))), (1, 0, 0, len(full(3, 1)))
    ]


# ---------------------------------------------------------------- decontamination


def brute_contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[i : i + window])].add(item)
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                own = grams.get(tuple(w[i : i + size]))
                if own:
                    hit |= set(range(i, i + size))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(map(str, found))))
    return out


def test_decontamination_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["Ab", "c", "d,", "É", "f1", "g"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 2, 3, 3, 9, 10, 10, 11, 14, 25, 40])] + [(20, None), (21, "--"), (22, say(3)), (23, "zzz yyy")]
    items.append((24, items[9][1]))
    docs = [(i, say(rng.randint(0, 60)) + (" new words " + items[rng.randrange(11)][1] if i % 3 else "")) for i in range(60)] + [(100, None), (101, ""), (None, items[8][1]), (3, "zzz yyy")]
    for most in (2_000_000, 20):
        got = decontaminate.find_contamination(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), max_item_words=most).collect()
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=key) == sorted(brute_contamination(docs, items), key=key)


def test_decontamination_removal(spark, documents, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.createDataFrame(documents, DOC_SCHEMA).withColumn("n_hit", F.lit("clash"))
    clean = decontaminate.remove_contamination(docs, bench)
    assert clean.columns == docs.columns
    assert decontaminate.find_contamination(clean, bench).filter("n_hit > 0").count() == 0
    before = {r.doc_id: r.n_hit for r in decontaminate.find_contamination(docs, bench).collect()}
    texts = {d.doc_id: d.text for d in documents}
    after = {r.doc_id: r.text for r in clean.collect()}
    assert all(after[k] == texts[k] for k, n in before.items() if not n)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, empty).filter("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


# ---------------------------------------------------------------- html


@pytest.fixture(scope="module")
def content_model():
    return html_content.train_content_model()


def brute_marginals(model, tree):
    n = len(tree.tag)
    unary = [sum(model.weights.get(f, 0.0) for f in fs) for fs in html_content.features(tree)]
    total, on = 0.0, [0.0] * n
    for state in range(1 << n):
        y = [(state >> i) & 1 for i in range(n)]
        w = math.exp(sum(u for u, v in zip(unary, y) if v) + sum(model.pair[y[tree.parent[i]]][y[i]] for i in range(1, n)))
        total += w
        for i in range(n):
            on[i] += w * y[i]
    return [x / total for x in on]


def test_sum_product_is_exact(content_model):
    page = "<body><nav><a href=x>y</a></nav><article><h1>T</h1><p>Some text, here. <div class=ad>Buy</div></article><footer>f</footer>"
    tree = html_content.parse(page)
    assert np.allclose(content_model.marginals(tree), brute_marginals(content_model, tree))


def test_html_pages(spark, sf_dir, content_model):
    """The test pages have one article with unclosed p and b; its text is known from the markup."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    import html as h

    for r, page in zip(queries.op5_html_extraction(spark, sf_dir).orderBy("page_id").collect(), pages.orderBy("page_id").collect()):
        body = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        lines = re.split(r"</?(?:p|h1)>", body)
        want = [" ".join(h.unescape(re.sub(r"</?(?:b|br)>", lambda m: " " if "br" in m[0] else "", x)).split()) for x in lines]
        assert r.text == "\n".join(x for x in want if x)
        assert r.n_chars == len(r.text)


def test_html_held_out(content_model):
    """Composed pages of another seed: nearly every block gets its label."""
    right = total = 0
    for source, labels in html_content.labelled_pages(60, seed=99):
        p = content_model.marginals(html_content.parse(source))
        right += sum((a >= 0.5) == bool(b) for a, b in zip(p, labels))
        total += len(labels)
    assert right / total > 0.97


def test_html_edges(spark, content_model):
    bad = ["", None, "plain", "<p", "<article><p>" + "a" * 10, "<div>" * 3000 + "deep text", "<script>never ends", "<b><i></b>x</i>", "<article><p>A &amp; B&nbsp;&lt;c&gt;\n d</p><script>x</script><!-- c --><p>E</article>"]
    table = spark.createDataFrame([(i, f"u{i}", x) for i, x in enumerate(bad)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_content.extract_main_text(table, content_model).collect()}
    assert len(got) == len(bad) and got[0] == got[1] == ""
    assert got[8] == "A & B <c> d\nE"
    assert html_content.extract_main_text(table.limit(0), content_model).count() == 0


# ---------------------------------------------------------------- repeats


def brute_repeats(texts, length):
    seen = Counter()
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        seen.update(r[i : i + length] for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        hit = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                hit[i : i + length] = True
        hit[len(r)] = False
        kept = bytes(b for b, h in zip(r, hit) if not h)
        out.append((len(r), int(hit.sum()), int((hit[1:] & ~hit[:-1]).sum() + hit[0]) if len(r) else 0, kept))
    return out


def check_repeats(spark, rows, length, gram, **options):
    got = bwt_dedup.remove_repeats(docs_of(spark, rows), length=length, gram=gram, **options).collect()
    mine = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, sum(int(b) - int(a) for a, b in (s.split(":") for s in r.spans)), len(r.spans), bytes(r.kept)) for r in got)
    want = sorted((d if d is not None else -1, *x) for (d, _), x in zip(rows, brute_repeats([t for _, t in rows], length)))
    assert mine == want


def test_repeats_small_alphabet(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abc") for _ in range(60))
    rows = []
    for i in range(40):
        t = "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 80)))
        if i % 2:
            a = rng.randint(0, 20)
            t += passage[a : rng.randint(a, 60)] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 20)))
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "a" * 100), (103, "ab" * 60), (104, rows[1][1]), (None, passage), (104, rows[1][1])]
    check_repeats(spark, rows, 20, 7)
    check_repeats(spark, rows, 20, 20)
    check_repeats(spark, rows, 20, 7, hot_anchor=2)
    check_repeats(spark, rows, 12, 3, hot_anchor=1)


def test_repeats_documents(spark, documents):
    check_repeats(spark, [(d.doc_id, d.text) for d in documents], bwt_dedup.LENGTH, bwt_dedup.GRAM)
    check_repeats(spark, [(d.doc_id, d.text) for d in documents[:60]], 40, 16, hot_anchor=3)


def test_repeats_hot_anchor_counts_bytes(spark):
    """A hot anchor is dealt by bytes: repeats of two- and three-byte letters with left overlaps around the quarters."""
    rng = random.Random(6)
    rows = []
    for letters in ("абвгдежз", "日本語文字列漢", "aéoü"):
        say = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        passage = say(120)
        for k in range(14):
            rows.append((len(rows), say(25) + passage[4 * k : 4 * k + 64 + 3 * (k % 4)] + say(25)))
    check_repeats(spark, rows, 100, 32, hot_anchor=2)


def test_repeats_empty(spark):
    assert bwt_dedup.remove_repeats(docs_of(spark, [])).count() == 0


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 40))) for _ in range(200)]
    shards = [bwt_dedup.SparseTransform.of([b""] * 50, texts[k : k + 50], 40, 8) for k in range(0, 200, 50)]
    _, order, lcp = bwt_dedup.merge_shards(shards, 40)
    ranked = [texts[i] for i in order]
    assert [t.ljust(40, b"\0") for t in ranked] == sorted(t.ljust(40, b"\0") for t in texts)
    for a, b, n in zip(ranked, ranked[1:], lcp[1:]):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        assert k == n


# ---------------------------------------------------------------- personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PII_TEXTS = [
    None, "", "a@b.c_d@e.f x@y", "foo@@bar.com a@b@c.d ..@a.b-c.d.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.000004", "1 2-3  4 4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111111111",
    "+1 (743) 555-3824. +12 34 +1234567 +1-2-3-4-5-6-7-8-)", "ü🙂 mail é a.b%c@d.é x@y.zz 🙂 10.0.0.1", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x = "abc"', "1" * 40000, "1.1." * 20000, "a" * 30000 + "@b" + ".c" * 20000, "a@b.c " * 500,
    "ssn 123-45-6789 DE89370400440532013000", "@", "+", "1234567812345670\n+1 222 333 4444 5555 6666",
]


def test_pii_base_spans(spark, documents):
    rows = [(i, t) for i, t in enumerate(PII_TEXTS)] + [(1000 + d.doc_id, d.text) for d in documents] + [(1, ""), (None, "q@r.st")]
    got = pii.find_pii(docs_of(spark, rows).withColumn("spans", F.lit(3))).collect()
    mine = sorted((r.doc_id if r.doc_id is not None else -1, [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in pii.BASE_KINDS]) for r in got)
    assert mine == sorted((d if d is not None else -1, base_spans(t)) for d, t in rows)
    order = {k: i for i, k in enumerate(pii.KINDS)}
    assert all([(order[s.kind], s.start) for s in r.spans] == sorted((order[s.kind], s.start) for s in r.spans) for r in got)


def test_pii_added_and_redaction(spark, documents):
    secrets = [(d.doc_id, d.text) for d in documents if d.text and re.search(r'(token|key|secret) = "[0-9a-f]{32,}"', d.text)]
    rows = secrets + [(i + 10_000, t) for i, t in enumerate(PII_TEXTS[:10])] + [(20_000 + i, f'note {i}: token = "{hashlib.sha1(str(i).encode()).hexdigest()}" ends') for i in range(30)]
    docs = docs_of(spark, rows).withColumn("pii_spans", F.lit("clash"))
    found = {r.doc_id: [s for s in r.spans if s.kind == "secret"] for r in pii.find_pii(docs).collect()}
    assert all(found[k] for k, _ in secrets) and all(found[20_000 + i] for i in range(30))
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    texts = dict(rows)
    for r in clean.collect():
        spans = base_spans(texts[r.doc_id])
        if not spans and not found[r.doc_id]:
            assert r.text == texts[r.doc_id]
        for s in spans:
            _, a, b = s.split(":")
            assert texts[r.doc_id][int(a) : int(b)] not in r.text
    assert pii.find_pii(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def test_pii_reliability():
    patterns = [("secret", (1, 1, 1, 1), 1, 300), ("secret", (1, 1, -1, 1), 1, 200), ("secret", (0, 0, -1, 0), 1, 400), ("secret", (1, 0, -1, -1), 1, 100), ("secret", (0, 1, -1, 0), 2, 5)]
    vote, post = pii.estimate_reliability(patterns)
    assert post[0] > 0.95 and post[2] < 0.05 and vote[0, 1, 1] > 0.8 > vote[0, 0, 1]


# ---------------------------------------------------------------- simhash


def plain_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), seed=42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(prints, ids, budget=2):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(root(i)) for i in range(len(prints))]


def test_simhash_documents(spark, documents):
    rows = [(d.doc_id, d.text) for d in documents] + [(1000 + i, t) for i, t in enumerate(EDGE_TEXTS)] + [(None, "none alone"), (None, None), (5, documents[0].text)]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    want = Counter(zip([d for d, _ in rows], (f"{p:016x}" for p in prints), components(prints, [d for d, _ in rows])))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


@pytest.mark.parametrize("hot", [50_000, 3])
def test_simhash_links_planted(spark, hot):
    rng = random.Random(hot)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base:
        x = b
        for _ in range(rng.randint(0, 12)):
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.bucket_links(spark.createDataFrame([(s,) for s in signed], "fp long"), hot_bucket=hot)
    roots = {r.node: r.root for r in simhash.connected_components(links).collect()}
    want = components(prints, list(range(len(prints))))
    mine = [signed.index(roots.get(s, s)) for s in signed]
    groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == v) for v in set(labels))
    assert groups(mine) == groups(want)


@pytest.mark.parametrize("hot", [50_000, 1])
def test_simhash_wider_budget(spark, hot):
    """Three differing bits, one in each of the fields of op8's budget."""
    a, b = 0x0123456789ABCDEF, 0x0123456789ABCDEF ^ (1 << 3 | 1 << 30 | 1 << 50)
    links = simhash.bucket_links(spark.createDataFrame([(a,), (b,)], "fp long"), budget=3, hot_bucket=hot).collect()
    assert {frozenset(r) for r in links} == {frozenset((a, b))}


def test_long_chain_components(spark):
    rng = random.Random(2)
    names = rng.sample(range(10**6), 300)
    chain = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    assert {r.root for r in simhash.connected_components(chain).collect()} == {min(names)}


def test_keep_one(spark):
    text = "one two three four five six seven"
    rows = [(3, text), (2, text), (2, text), (None, text), (None, "lonely words without company here now"), (None, None), (9, "other things entirely said in this one")]
    docs = docs_of(spark, rows).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    kept = simhash.keep_one(docs, shingle=5)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(2, text), (None, rows[4][1]), (None, None), rows[6]]))
    assert simhash.keep_one(docs.limit(0)).count() == 0 and simhash.near_duplicates(docs.limit(0)).count() == 0


def brute_near_copies(rows, shingle=5):
    """Ids that stay: the least of each group linked by a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())


def planted_near_copies(rng):
    """Copies with some words changed, over all similarities around 0.8, among texts that share a passage."""
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage, rows = say(40), []
    for size in (6, 12, 30, 100, 300, 1000):
        for changed in (0, 1, 2, 3, 5, 8, 12, 20):
            base = say(size) + (passage if changed % 2 else [])
            copy = list(base)
            for k in rng.sample(range(size), min(changed, size)):
                copy[k] = "Ünew"
            rows += [" ".join(base), " \n".join(copy).upper()]
    group = say(200)
    for _ in range(40):
        copy = list(group)
        for k in rng.sample(range(200), rng.randint(0, 5)):
            copy[k] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(copy))
    rows += [None, "", " \t", "one two", "One Two", "one two three", *(" ".join(say(30) + passage) for _ in range(60))]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("common", [16, 2])
def test_pipeline_near_copies_brute_force(spark, sf_dir, monkeypatch, common):
    monkeypatch.setattr(near_copies, "COMMON", common)
    rows = planted_near_copies(random.Random(common))
    kept = dict(corpus_pipeline.STAGES)["simhash near-duplicates"](spark, docs_of(spark, rows), sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == brute_near_copies(rows)


def set_print(text, shingle=5):
    """The fingerprint of a text in the near-copy stage."""
    block = next(blocks(pa.array([text])))
    return simhash.majority(near_copies.shingle_sets(block, shingle)[0])


def test_pipeline_near_copies_by_fingerprint(spark, sf_dir, monkeypatch):
    """With no tie of shingles, copies within the budget of bits are linked by their fingerprints, and only if they are similar."""
    monkeypatch.setattr(near_copies, "_ties", lambda prefixes: spark.createDataFrame([], "a long, b long"))
    rng = random.Random(15)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, want = [], set()
    for size, changed in ((150, 1), (150, 3), (400, 1), (400, 8), (900, 1), (900, 3), (900, 15)):
        base = say(size)
        copy = ["Unew" if k % (size // changed) == 9 else w for k, w in enumerate(base)]
        pair = [" ".join(base), " ".join(copy)]
        near = (set_print(pair[0]) ^ set_print(pair[1])).bit_count() <= near_copies.BUDGET
        want |= {len(rows)} if near else {len(rows), len(rows) + 1}
        rows += pair
    assert 7 < len(want) < 14
    # a text without words has fingerprint zero; a few words may come within the budget of it, and are not similar
    few = next(t for t in (" ".join(say(6)) for _ in range(100_000)) if set_print(t).bit_count() <= near_copies.BUDGET)
    want |= {len(rows), len(rows) + 1}
    rows += [few, ""]
    kept = dict(corpus_pipeline.STAGES)["simhash near-duplicates"](spark, docs_of(spark, list(enumerate(rows))), sf_dir)
    assert {r.doc_id for r in kept.collect()} == want


def test_simhash_all_buckets_dealt_again(spark):
    """Five differing bits in five of six fields, among fingerprints that are far from all others."""
    rng = random.Random(5)
    a = rng.getrandbits(63)
    b = a ^ (1 << 2 | 1 << 12 | 1 << 25 | 1 << 40 | 1 << 50)
    prints = [a, b, a ^ (1 << 2 | 1 << 12 | 1 << 25 | 1 << 40 | 1 << 50 | 1 << 60), *(rng.getrandbits(63) for _ in range(50))]
    got = {hot: {frozenset(r) for r in simhash.bucket_links(spark.createDataFrame([(p,) for p in prints], "fp long"), 5, hot).collect()} for hot in (0, 50_000)}
    want = {frozenset((prints[1], prints[2])), frozenset((a, b))}
    assert got[0] == got[50_000] == want


def test_similar_groups_of_classes():
    """Sets of one class are reached together, whatever they share; unlike ones without shared elements stay apart."""
    a, b, c, d = (np.arange(k, k + 100, dtype=np.uint64) for k in (0, 500, 505, 900))
    none = np.zeros(0, np.uint64)
    assert near_copies.similar_groups([a, b, c, d]).tolist() == [0, 1, 1, 3]
    assert near_copies.similar_groups([a, b, c, d], np.array([7, 3, 5, 7])).tolist() == [0, 1, 1, 0]
    assert near_copies.similar_groups([a, b, c, d], np.array([7, 3, 7, 5])).tolist() == [0, 0, 0, 3]
    assert near_copies.similar_groups([none, a, d]).tolist() == [0, 1, 2]


# ---------------------------------------------------------------- language


def test_language_held_out(spark, documents, sf_dir):
    got = {r.doc_id: r for r in queries.op9_language_id(spark, sf_dir).collect()}
    from zlib import crc32

    assert all(r.held_out == (crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert all(0 <= r.score <= 1 for r in got.values())
    test = [(got[d.doc_id].lang_pred, d.lang) for d in documents if got[d.doc_id].held_out and d.text and len(d.text) > 40]
    assert np.mean([a == b for a, b in test]) > 0.9


def test_language_edges(spark):
    docs = docs_of(spark, [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(["the cat and the dog", "der hund und die katze", None, "", "123 !!", "ß", "日本"] * 8)], "doc_id long, text string, lang string")
    model = langid.train_language_model(docs)
    rows = langid.predict_language(docs.withColumn("score", F.lit("clash")), model).collect()
    for r in rows:
        text = ["the cat and the dog", "der hund und die katze", None, "", "123 !!", "ß", "日本"][r.doc_id % 7]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    empty = langid.train_language_model(docs.limit(0))
    assert {r.lang_pred for r in langid.predict_language(docs, empty).collect()} == {"und"}
    assert langid.predict_language(docs.limit(0), model).count() == 0


# ---------------------------------------------------------------- token counts


def plain_count(word, v):
    path = tokencount.WORD_MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(path) + 1):
        n = len(path[end - 1].encode())
        options = [(best[end - 1][0] + n * v.byte_score, best[end - 1][1] + n)]
        options += [(best[k][0] + v.score[path[k:end]], best[k][1] + 1) for k in range(end) if path[k:end] in v.score]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


def test_token_counts(spark, documents, sf_dir):
    v = tokencount.UnigramVocabulary.load()
    words = sorted({w for d in documents for w in re.findall(r"[^\x20\x09-\x0D]+", d.text or "")} | {"", "é", "日本語", "a" * 300})
    counts = tokencount.trie_counts(words, v)
    for w in words[:: max(1, len(words) // 1500)]:
        assert counts[w] == plain_count(w, v)
    got = {r.doc_id: (r.n_pretokens, r.n_tokens, r.n_chars) for r in queries.op10_token_counts(spark, sf_dir).collect()}
    for d in documents:
        own = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        assert got[d.doc_id] == (len(own), sum(counts[w] for w in own), len(d.text or ""))
    edges = {(r.doc_id, r.n_pretokens) for r in tokencount.count_tokens(edge_docs(spark), v).collect()}
    assert (0, 0) in edges and (None, 0) in edges and (None, 3) in edges
    assert tokencount.count_tokens(edge_docs(spark).limit(0), v).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_against_its_parts(spark, sf_dir, documents):
    """Each stage on its own input against a plain version of its decision."""
    texts = {d.doc_id: d for d in documents}
    docs = spark.createDataFrame(documents, DOC_SCHEMA)
    fs = dict(corpus_pipeline.STAGES)
    kept = fs["quality rules"](spark, docs, sf_dir).cache()
    ids = {r.doc_id for r in kept.collect()}
    heads = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids == {r.doc_id for r in quality.score_quality(docs, heads).filter("kept").collect()}
    assert not any(base_rules(texts[i].text)[-1] for i in ids)

    single = fs["simhash near-duplicates"](spark, kept, sf_dir).cache()
    assert sorted(r.doc_id for r in single.collect()) == brute_near_copies([(i, texts[i].text) for i in sorted(ids)])

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = fs["benchmark decontamination"](spark, single, sf_dir).cache()
    rows = clean.collect()
    assert all(n == 0 for _, _, n, _ in brute_contamination([(r.doc_id, r.text) for r in rows], bench))
    dirty = {d for d, w, n, _ in brute_contamination([(r.doc_id, r.text) for r in single.collect()], bench) if n > 0.8 * w}
    assert {r.doc_id for r in rows} == {r.doc_id for r in single.collect()} - dirty

    private = fs["personal data"](spark, clean, sf_dir).cache()
    assert private.columns == docs.columns and private.count() == clean.count()
    assert all(r.n_chars == len(r.text) for r in private.collect())

    mixed = fs["mixing"](spark, private, sf_dir)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in whole.collect())


def test_pipeline_edges(spark, sf_dir):
    odd = docs_of(spark, [(i, t, None, None, None) for i, t in enumerate(EDGE_TEXTS)] + [(None, "w " * 60, "en", "s", 120)] * 2, DOC_SCHEMA).withColumn("kept", F.lit("clash"))
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            out.collect()
