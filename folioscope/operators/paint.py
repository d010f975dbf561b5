"""What is painted on a page and in which order, and which texts a reader does not copy.

:func:`operations` merges backgrounds, code boxes, bands behind highlighted lines and texts
into one list of operations a page: the page first, then boxes, then bands, then texts, each
in its own order.  :func:`hidden_texts` finds the texts that are line numbers, wrap marks
and badges: those that begin within a marker's rectangle, as long as the rectangle's glyphs
last.

Scale: all is keyed by document and page.  Texts and rectangles are dealt and sorted once;
what is left is a fold over a page's texts in their order, one stream of pages, which holds
the rectangles and budgets of one page, by bands of height.

Defined cases: texts that touch no rectangle, without glyphs, or longer than what is left of
a budget stay as they are; of several rectangles the first with a budget counts; pages
without any operation are not there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

PT_PER_MM = 72 / 25.4
#: How far beside a rectangle a text may begin (pt), and the height of a band of a page by which they meet.
TOLERANCE_PT, BAND_PT = 0.8, 24.0
# Corners and strip of a code box (mm), its line (pt), and the share of a radius at which a quarter circle's control points lie.
CORNER_MM, STRIP_MM, LINE_PT, ARC = 1.0, 1.1, 0.8, 0.5523


def _number(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def _row(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _colour(column: str) -> Column:
    return _row(*(_number(T.rgb01(F.col(column), k), 4) for k in range(3)))


def rounded_path(x: Column, y: Column, width: Column, height: Column, left: Column, right: Column) -> Column:
    """The outline of a rectangle (pt, from its lower left corner), with one radius for the corners of each side."""
    radii = T.fit_radii(width, height, (left, right, right, left))
    a, b = radii[0], radii[1]
    x1, y1 = x + width, y + height
    n = _number

    def corner(radius: Column, *points: Column) -> Column:
        return F.when(radius > 0, F.concat(F.lit("\n"), _row(*map(n, points), "c"))).otherwise("")

    return F.concat(
        _row(n(x + a), n(y), "m"),
        F.lit("\n"), _row(n(x1 - b), n(y), "l"), corner(b, x1 - b + ARC * b, y, x1, y + b - ARC * b, x1, y + b),
        F.lit("\n"), _row(n(x1), n(y1 - b), "l"), corner(b, x1, y1 - b + ARC * b, x1 - b + ARC * b, y1, x1 - b, y1),
        F.lit("\n"), _row(n(x + a), n(y1), "l"), corner(a, x + a - ARC * a, y1, x, y1 - a + ARC * a, x, y1 - a),
        F.lit("\n"), _row(n(x), n(y + a), "l"), corner(a, x, y + a - ARC * a, x + a - ARC * a, y, x + a, y),
        F.lit("\nh"),
    )


def _placed(rects: DataFrame, page_height_mm: Column) -> tuple[Column, Column, Column, Column]:
    """x, y, width and height in points, from the lower left corner of the page."""
    return F.col("x_mm") * PT_PER_MM, (page_height_mm - F.col("y_mm") - F.col("height_mm")) * PT_PER_MM, F.col("width_mm") * PT_PER_MM, F.col("height_mm") * PT_PER_MM


def operations(pages: DataFrame, boxes: DataFrame, bands: DataFrame, texts: DataFrame, key: str = "doc") -> DataFrame:
    """(key, page, op_no, layer, op): all that is painted on each page, in order.

    pages: (key, page, width_mm, height_mm, colour), colour null for none; boxes: (key, page,
    n, x_mm, y_mm, width_mm, height_mm, fill, border, accent); bands: the same with colour;
    texts: (key, page, n, op).
    """
    sizes = pages.select(key, "page", F.col("height_mm").alias("page_mm"))
    whole = pages.filter("colour IS NOT NULL").select(
        key, "page", F.lit(0).alias("layer"), F.lit(0).cast("long").alias("n"),
        _row("q", _colour("colour"), "rg 0 0", _number(F.col("width_mm") * PT_PER_MM), _number(F.col("height_mm") * PT_PER_MM), "re f Q").alias("op"),
    )
    held = boxes.join(sizes, [key, "page"])
    x, y, w, h = _placed(held, F.col("page_mm"))
    corner, none = F.lit(CORNER_MM * PT_PER_MM), F.lit(0.0)
    box = F.concat_ws("\n", F.lit("q"), _row(_colour("fill"), "rg", _colour("border"), "RG", _number(F.lit(LINE_PT)), "w"), rounded_path(x, y, w, h, corner, corner), F.lit("B"), _row(_colour("accent"), "rg"), rounded_path(x, y, F.lit(STRIP_MM * PT_PER_MM), h, corner, none), F.lit("f"), F.lit("Q"))
    drawn = held.select(key, "page", F.lit(1).alias("layer"), F.col("n").cast("long").alias("n"), box.alias("op"))
    lit = bands.join(sizes, [key, "page"])
    x, y, w, h = _placed(lit, F.col("page_mm"))
    band = F.concat_ws("\n", F.lit("q"), _row(_colour("colour"), "rg"), _row(_number(x), _number(y), _number(w), _number(h), "re"), F.lit("f"), F.lit("Q"))
    marked = lit.select(key, "page", F.lit(2).alias("layer"), F.col("n").cast("long").alias("n"), band.alias("op"))
    said = texts.select(key, "page", F.lit(3).alias("layer"), F.col("n").cast("long").alias("n"), "op")
    order = Window.partitionBy(key, "page").orderBy("layer", "n", "op")
    return whole.union(drawn).union(marked).union(said).select(key, "page", F.row_number().over(order).alias("op_no"), "layer", "op")


def hidden_texts(shows: DataFrame, rects: DataFrame, key: str = "doc") -> DataFrame:
    """The texts (key, page, n, x, y, glyphs, in points) with ``rect``: the number of the marker that they belong to, or null.

    rects: (key, page, rect, x, y, width, height, glyphs).  On a page, in the order of n, a
    text takes its glyphs from the first rectangle that it begins in and that has as many left.
    """
    own = [c for c in shows.columns if c not in (key, "page", "n")]
    spot = [F.col(c).cast("double") for c in ("x", "y")]
    columns = [key, "page", "_is_text", "_o", "_x", "_y", "_g", "_w", "_h", "_text"]
    none = F.lit(None).cast("double")
    texts = shows.select(key, "page", F.lit(True), F.col("n").cast("long"), *[none] * 5, F.struct("n", *own)).toDF(*columns)
    empty = F.lit(None).cast(texts.schema["_text"].dataType)
    marks = rects.select(key, "page", F.lit(False), F.col("rect").cast("long"), *spot, F.col("glyphs").cast("double"), F.col("width").cast("double"), F.col("height").cast("double"), empty).toDF(*columns)
    # one exchange: the rectangles of a page come before its texts
    dealt = marks.union(texts).repartition(key, "page").sortWithinPartitions(key, "page", "_is_text", "_o", "_g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, left, bands = None, {}, {}
        for batch in batches:
            owners = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            is_text = batch.column(2).to_numpy(zero_copy_only=False)
            said = dict(zip(["n", *own], batch.column(9).flatten()))
            spots = [pc.if_else(batch.column(2), said[c].cast(pa.float64()), batch.column(k)) for c, k in (("x", 4), ("y", 5), ("glyphs", 6))]
            taken = []
            for owner, text, n, x, y, glyphs, w, h in zip(owners, is_text.tolist(), *(c.to_numpy(zero_copy_only=False).tolist() for c in (batch.column(3), *spots, *batch.columns[7:9]))):
                if owner != of:
                    of, left, bands = owner, {}, {}
                if text:
                    hit = None
                    # without a place or glyphs no comparison holds
                    if glyphs > 0 and x == x and abs(y) < math.inf:
                        for rect, x0, x1, y0, y1 in bands.get(y // BAND_PT, ()):
                            if x0 <= x <= x1 and y0 <= y <= y1 and glyphs <= left[rect]:
                                left[rect] -= glyphs
                                hit = rect
                                break
                    taken.append(hit)
                elif None not in owner and abs(y) + abs(h) < math.inf:
                    left.setdefault(n, glyphs)
                    y0, y1 = y - TOLERANCE_PT, y + h + TOLERANCE_PT
                    for k in range(int(y0 // BAND_PT), int(y1 // BAND_PT) + 1):
                        bands.setdefault(k, []).append((n, x - TOLERANCE_PT, x + w + TOLERANCE_PT, y0, y1))
            rows = batch.filter(pa.array(is_text))
            shown = rows.column(9)
            yield pa.record_batch([*rows.columns[:2], *shown.flatten(), pa.array(taken, pa.int64())], names=[key, "page", "n", *own, "rect"])

    kinds = ", ".join(f"`{c}` {shows.schema[c].dataType.simpleString()}" for c in (key, "page", "n", *own))
    return dealt.mapInArrow(run, f"{kinds}, rect long")
