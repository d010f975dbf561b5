"""Documents laid out: wrapped texts, tables, code and pages against plain versions and literal cases."""

import random

import numpy as np
import pytest

from folioscope.functions import constants as K
from folioscope.operators import layout, relational

SCHEMA = "doc int, pos int, kind string, level int, text string, lang string, depth int, tbl struct<header:array<string>,rows:array<array<string>>,columns:int>, image double"


def plain_lines(text, width, pt, bold=False):
    """Line after line: the longest part that fits and ends with a word, or as many characters as fit."""
    advance = layout._advances(pt, bold)
    size = lambda s: sum(int(advance[min(ord(c), 128)]) for c in s)
    out, rest = [], text
    while True:
        if size(rest) <= width:
            return [*out, rest]
        ends = [k for k, c in enumerate(rest) if c == " " and size(rest[:k]) <= width and k > 0]
        k = ends[-1] if ends else max(1, max(j for j in range(len(rest)) if size(rest[:j]) <= width))
        out.append(rest[:k])
        rest = rest[k + 1 :] if ends else rest[k:]
        if not rest:
            return out


def test_lines_against_plain():
    rng = random.Random(1)
    for _ in range(400):
        text = " ".join("".join(rng.choices("iWmé日.", k=rng.choice((1, 3, 5, 9, 40)))) for _ in range(rng.randrange(1, 12)))
        pt, width = rng.choice((8, 9, 12, 17)), rng.randrange(8_000, 90_000)
        starts = layout.line_starts(text, width, pt)
        assert [text[a:b].strip(" ") for a, b in zip(starts, [*starts[1:], len(text)])] == [x.strip(" ") for x in plain_lines(text, width, pt)]


def test_widths():
    assert len(K.SANS_WIDTHS.split()) == len(K.BOLD_WIDTHS.split()) == 95
    assert layout.n_lines(None, 100, 12) == layout.n_lines("", 100, 12) == 1
    assert layout.line_um(12) == round(12 * 1.149 * 1.3 * 25400 / 72)


def test_columns_of_tables():
    rows = [["ab", "x" * 50, "y" * 200], ["abcd", "x" * 40, ""]]
    assert layout.column_widths([], rows, 3, 60_000) == [10_000, 20_000, 30_000]
    assert layout.column_widths(["h"], [["a"], ["b"]], 1, 7) == [7]
    line = layout.line_um(9)
    assert layout.row_heights(["a"], [["one\n\ntwo"], [None], ["x " * 100]], 1, 60_000) == [line + 2000, 2 * line + 2000, line + 2000, layout.n_lines("x " * 100, 56_000, 9) * line + 2000]


@pytest.mark.parametrize("lines, first, want", [(3, 100.0, [0, 0, 0]), (5, 14.0, [1, 1, 1, 1, 1]), (70, 30.0, [0] * 6 + [1] * 63 + [2])])
def test_code_padding(spark, lines, first, want):
    """The padding of the box counts in the decision to move, and on every page."""
    rows = spark.createDataFrame([(1, k, k) for k in range(lines)], "b int, vline_no int, unit int")
    placed = relational.paginate(rows, "b", first_mm=first, page_mm=271.0, line_mm=4.2).orderBy("vline_no").collect()
    pages = [r.page_no for r in placed]
    if lines == 70:  # 271 - 4 hold 63 lines, 30 - 4 hold six; one line alone would be left
        assert pages == [0] * 6 + [1] * 62 + [2] * 2
    else:
        assert pages == want
    tops = {r.page_no: r.y_mm for r in reversed(placed)}
    assert tops[pages[0]] == pytest.approx((271.0 - first if not pages[0] else 0) + 2)


def test_a_band_for_each_visual_line(spark):
    rows = spark.createDataFrame([(1, 0, 0, True), (1, 1, 0, True), (1, 2, 1, False), (1, 3, 2, True)], "b int, vline_no int, unit int, highlighted boolean")
    bands = relational.highlight_bands(relational.paginate(rows, "b", first_mm=200.0, page_mm=271.0, line_mm=4.0), "b", line_mm=4.0).orderBy("vline_no").collect()
    assert [(r.vline_no, r.top_mm, r.bottom_mm) for r in bands] == [(0, 73.0, 77.0), (1, 77.0, 81.0), (3, 85.0, 89.0)]


def test_max_columns(spark):
    rows = spark.createDataFrame([(174.0, 9.0), (174.0, 16.0), (10.0, 9.0), (20.0, 16.0), (24.0, 16.0)], "w double, pt double")
    assert [r.n for r in rows.select(relational.max_columns(rows.w, rows.pt).alias("n")).collect()] == [89, 50, 12, 12, 12]


class Plain:
    """A page as a list of what stands on it, filled piece by piece."""

    def __init__(self, page):
        self.page, self.number, self.used = page, 1, 0

    def put(self, before, heights, units, pad, after, moves):
        self.used = min(self.page, self.used + before)
        whole = sum(heights) + 2 * pad
        if heights and moves and self.page - self.used + 500 < whole <= self.page - 1000:
            self.number, self.used = self.number + 1, 0
        first, at = None, 0
        while at < len(heights):
            groups = [[at]]
            for k in range(at + 1, len(heights)):
                if units is not None and units[k] == units[k - 1]:
                    groups[-1].append(k)
                else:
                    groups.append([k])
            room, taken = self.page - self.used - 2 * pad, []
            for g in groups:
                if sum(heights[k] for k in taken + g) > room:
                    break
                taken += g
            if not taken and units is not None:  # a source line longer than the page is cut
                while at + len(taken) < len(heights) and sum(heights[at : at + len(taken) + 1]) <= room:
                    taken.append(at + len(taken))
            if units is not None and len(heights) - at - len(taken) == 1 and len(taken) > 1:
                last = [k for k in taken if units[k] == units[taken[-1]]]
                taken = taken[: -len(last)] if len(last) < len(taken) else taken
            if not taken:
                if self.used:
                    self.number, self.used = self.number + 1, 0
                    continue
                taken = [at]
            first = first or (self.number, self.used)
            self.used = min(self.page, self.used + sum(heights[k] for k in taken) + 2 * pad)
            at += len(taken)
            if at < len(heights):
                self.number, self.used = self.number + 1, 0
        first = first or (self.number, self.used)
        out = (*first, self.number, self.used)
        self.used = min(self.page, self.used + after)
        return out


def test_fold_against_plain():
    rng = random.Random(3)
    for _ in range(300):
        page = rng.choice((20_000, 50_000, 90_000))
        fold, other = layout._Fold(page), Plain(page)
        for _ in range(rng.randrange(1, 25)):
            n = rng.choice((0, 1, 2, 5, 30))
            code = rng.random() < 0.4
            heights = [4676] * n if code else [rng.choice((1000, 6000, 45_000)) for _ in range(n)]
            units = np.cumsum([rng.random() < 0.6 for _ in range(n)]).tolist() if code else None
            one = (rng.choice((0, 2529)), heights, units, rng.choice((0, 2000)), rng.choice((0, 3000)), code)
            assert fold.block(*one) == other.put(*one)


def test_documents(spark):
    """Two documents of all kinds: blocks in order, each from where the last one ended."""
    table = {"header": ["a", "b"], "rows": [["1", "2"]], "columns": 2}
    rows = [
        (1, 0, "title", None, "A title", None, None, None, None), (1, 1, "heading", 2, "Head", None, None, None, None), (1, 2, "paragraph", None, "word " * 300, None, None, None, None), (1, 3, "quote", None, "said", None, None, None, None),
        (1, 4, "code", None, "x\ny", "python", None, None, None), (1, 5, "table", None, None, None, None, table, None), (1, 6, "image", None, None, None, None, None, 150.0), (1, 7, "image", None, None, None, None, None, None),
        (1, 8, "image", None, None, None, None, None, 0.0), (1, 9, "divider", None, None, None, None, None, None), (1, 10, "list_item", None, "an item", None, 1, None, None), (1, 11, None, None, None, None, None, None, None),
        (2, 0, "caption", None, None, None, None, None, None),
    ]
    blocks = spark.createDataFrame(rows, SCHEMA)
    laid = layout.placed(layout.measured(blocks, width_mm=174.0, image_mm="image"), "doc", page_mm=271.0).orderBy("doc", "pos").collect()
    assert [r.pos for r in laid] == [*range(12), 0] and laid[-1].page == 1 and laid[-1].y_um == 0
    ends = [(r.last_page, r.end_um) for r in laid[:12]]
    starts = [(r.page, r.y_um) for r in laid[:12]]
    assert all(s >= e for s, e in zip(starts[1:], ends)) and starts[0] == (1, 0)
    assert ends[4][1] - starts[4][1] == 3 * layout.line_um(9, True) + 4000 and starts[6][0] == 2
    assert starts[8] == ends[8] and starts[11] == ends[11]


def test_bookmarks_and_summary(spark):
    rows = [(1, 0, "title", None, "T", None, None, None, None), (1, 1, "image", None, None, None, None, None, 255.0), (1, 2, "heading", 1, "H", None, None, None, None), (1, 3, "code", None, "\n".join("x" * 99), None, None, None, None)]
    laid = layout.placed(layout.measured(spark.createDataFrame(rows, SCHEMA), width_mm=174.0, image_mm="image"), "doc", page_mm=271.0)
    from pyspark.sql import functions as F

    marks = layout.bookmarks(laid, page_height_mm=F.lit(297.0), top_mm=F.lit(10.0)).orderBy("pos").collect()
    # the heading does not fit behind the picture, so its bookmark leads to the page where it stands
    assert [(r.level, r.page, round(r.top_pt, 3)) for r in marks] == [(0, 1, 813.543), (1, 2, 813.543)]
    assert layout.summary(laid, "doc").collect()[0].asDict() == {"doc": 1, "pages": 3, "bookmarks": 2, "code_splits": 1, "highlighted_lines": 0, "missing_glyphs": 0}
