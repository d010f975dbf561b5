"""Fonts by ranges, operations of pages in order, and texts that are not copied."""

import random

import pytest

from folioscope.operators import fonts, paint

RANGES = [("sans", 0x20, 0x7E), ("sans", 0x100, 0x1FF), ("sans", 0x180, 0x210), ("fall", 0x2500, 0x25FF), ("fall", 0x1F600, 0x1F64F), ("odd", 0x30, 0x20)]


@pytest.fixture(scope="module")
def ranges(spark):
    return spark.createDataFrame(RANGES, "font string, lo int, hi int")


def test_coverage(spark, ranges):
    chars = spark.createDataFrame([(c,) for c in "aĀƀȐȑ│😀é"], "ch string")
    assert {r.ch: r.fonts for r in fonts.fonts_of(chars, ranges).collect()} == {"a": ["sans"], "Ā": ["sans"], "ƀ": ["sans"], "Ȑ": ["sans"], "│": ["fall"], "😀": ["fall"]}


TEXTS = ["plain text", "a│b 😀😀 c", "││", "é only é", "│é│ ­", "", None, "\n\t│\n"]


def test_plans_and_runs(spark, ranges):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")
    plan = {r.k: ("".join(r.falls), "".join(r.missing)) for r in fonts.font_plan(rows, "k", ranges, main="sans", fallback="fall").collect()}
    assert plan == {1: ("│😀", ""), 2: ("│", ""), 3: ("", "é"), 4: ("│", "é"), 7: ("│", "")}
    want = []
    for k, text in enumerate(TEXTS):
        run = at = 0
        while at < len(text or ""):
            falls = text[at] in "│😀"
            end = next((j for j in range(at, len(text)) if (text[j] in "│😀") != falls), len(text))
            run += 1
            want.append((k, run, falls, at, end - at))
            at = end
    got = fonts.text_runs(rows, "k", ranges, main="sans", fallback="fall").collect()
    assert sorted(map(tuple, got)) == want


def plain_hidden(shows, rects):
    left = {(d, p, r): g for d, p, r, *_, g in rects}
    out = []
    for d, p, n, x, y, g in sorted(shows, key=lambda s: s[:3]):
        hit = None
        for d2, p2, r, rx, ry, w, h, _ in sorted(rects, key=lambda s: s[:3]):
            if (d, p) == (d2, p2) and 0 < g <= left[d, p, r] and rx - 0.8 <= x <= rx + w + 0.8 and ry - 0.8 <= y <= ry + h + 0.8:
                left[d, p, r] -= g
                hit = r
                break
        out.append((d, p, n, hit))
    return sorted(out, key=str)


def test_hidden_texts(spark):
    """Overlapping rectangles, edges, and budgets that run out, against one pass over every page."""
    rng = random.Random(5)
    rects = [(d, p, r, rng.uniform(0, 60), rng.uniform(-10, 200), rng.uniform(1, 40), rng.uniform(1, 60), rng.randrange(8)) for d in range(4) for p in range(2) for r in range(9)]
    shows = [(d, p, n, rng.uniform(0, 90), rng.uniform(-20, 230), rng.randrange(5)) for d in range(5) for p in range(2) for n in range(60)]
    shows += [(*r[:2], 100 + r[2], r[3] + r[5] + 0.79, r[4] + r[6] + 0.79, 1) for r in rects] + [(*r[:2], 200 + r[2], r[3] - 0.81, r[4], 1) for r in rects]
    got = paint.hidden_texts(
        spark.createDataFrame(shows, "doc int, page int, n int, x double, y double, glyphs int"), spark.createDataFrame(rects, "doc int, page int, rect long, x double, y double, width double, height double, glyphs int")
    ).select("doc", "page", "n", "rect")
    assert sorted(map(tuple, got.collect()), key=str) == plain_hidden(shows, rects)


def test_order_of_operations(spark):
    place = "doc int, page int, n int, x_mm double, y_mm double, width_mm double, height_mm double"
    pages = spark.createDataFrame([(1, 1, 100.0, 200.0, "FF0000"), (1, 2, 100.0, 200.0, None)], "doc int, page int, width_mm double, height_mm double, colour string")
    boxes = spark.createDataFrame([(1, 1, 2, 10.0, 20.0, 30.0, 40.0, "000000", "FFFFFF", "00FF00"), (1, 1, 1, 10.0, 90.0, 30.0, 0.5, "000000", "FFFFFF", "00FF00")], place + ", fill string, border string, accent string")
    bands = spark.createDataFrame([(1, 1, 1, 12.0, 22.0, 26.0, 5.0, "0000FF")], place + ", colour string")
    texts = spark.createDataFrame([(1, 1, 2, "b"), (1, 1, 1, "a"), (1, 2, 1, "c")], "doc int, page int, n int, op string")
    got = paint.operations(pages, boxes, bands, texts).orderBy("page", "op_no").collect()
    assert [(r.page, r.op_no, r.layer) for r in got] == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 3), (1, 6, 3), (2, 1, 3)]
    assert got[0].op == "q 1.0000 0.0000 0.0000 rg 0 0 283.46 566.93 re f Q" and [r.op for r in got[4:]] == ["a", "b", "c"]
    assert got[3].op == "q\n0.0000 0.0000 1.0000 rg\n34.02 490.39 73.70 14.17 re\nf\nQ"
    # a box lower than two radii has corners of half its height
    assert "\n28.35 310.39 m\n" not in got[1].op and got[1].op.split("\n")[2] == "29.06 310.39 m"
    assert got[2].op.split("\n")[:3] == ["q", "0.0000 0.0000 0.0000 rg 1.0000 1.0000 1.0000 RG 0.80 w", "31.18 396.85 m"]
    assert got[2].op.count(" c\n") == 4 + 2 and got[2].op.endswith("f\nQ")


def test_hidden_texts_are_dealt_once(spark):
    """Texts and rectangles meet in one exchange, and a text without a place, a page or glyphs has no rectangle."""
    rects = spark.createDataFrame([(1, 1, 7, 0.0, 0.0, 9.0, 9.0, 5), (None, 1, 8, 0.0, 0.0, 9.0, 9.0, 5)], "doc int, page int, rect long, x double, y double, width double, height double, glyphs int")
    shows = spark.createDataFrame([("a", 1, 1, 1, 1.0, 1.0, 2), ("b", 1, 1, 2, None, 1.0, 1), ("c", 1, 1, 3, 1.0, None, 1), ("d", 1, 1, 4, 1.0, 1.0, None), ("e", None, 1, 5, 1.0, 1.0, 1), ("f", 1, 1, 6, 1.0, 1.0, 3)], "said string, doc int, page int, n int, x double, y double, glyphs int")
    got = paint.hidden_texts(shows, rects)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert got.columns == ["doc", "page", "n", "said", "x", "y", "glyphs", "rect"]
    assert {r.said: r.rect for r in got.collect()} == {"a": 7, "b": None, "c": None, "d": None, "e": None, "f": 7}
