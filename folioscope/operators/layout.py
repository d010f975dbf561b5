"""Whole documents laid out on pages: measured texts, tables and code, and where every block stands.

Two steps.  :func:`measured` gives each block the heights of its pieces (lines of text, rows
of a table, visual lines of code, a picture), which no page end cuts, with the gaps around
it; texts are broken where the words end that still fit, found by a search in the running
sum of their advances.  :func:`placed` carries an offset over the blocks of a document in
their order and gives page and height of each; bookmarks and destinations follow.

All lengths are whole micrometres, so sums are exact and the same in any order.

Scale: measuring is one Arrow pass without a shuffle.  Placing deals documents by their key
and streams each in the order of its blocks; between two blocks only a page number and an
offset are held, so a document of any length takes time, not memory, in proportion to it.

Defined cases: null texts are empty and take one line; a word longer than a line is cut; a
piece taller than a page begins on a new one and is cut by its end; null kinds and kinds not
known take no room; a document without blocks is not there.  Of a code box the line that
names the language is as high as the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import constants as K
from folioscope.functions import text as T
from folioscope.operators.relational import page_end

UM_PER_PT = 25400 / 72


def line_um(pt: float, mono: bool = False) -> int:
    """Height of a line of text."""
    return round(pt * (K.MONO_LINE if mono else K.SANS_LINE) * K.LINE_SPACING * UM_PER_PT)


@lru_cache(maxsize=64)
def _advances(pt: float, bold: bool) -> np.ndarray:
    """Advance of each ASCII character, and at the end of all others."""
    own = list(map(int, (K.BOLD_WIDTHS if bold else K.SANS_WIDTHS).split()))
    return np.array([round(w * pt * UM_PER_PT / 1000) for w in [K.OTHER_WIDTH] * 32 + own + [K.OTHER_WIDTH] * 2], np.int64)


def line_starts(text: str, width_um: int, pt: float, bold: bool = False) -> list[int]:
    """Where the lines of a text begin: each holds as many words as fit, or as much of a word that does not."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    end = np.concatenate([[0], np.cumsum(_advances(pt, bold)[np.minimum(codes, 128)])])
    space = np.maximum.accumulate(np.where(codes == 0x20, np.arange(len(codes)), -1))
    starts, at, n = [0], 0, len(codes)
    while (fits := int(np.searchsorted(end, end[at] + width_um, "right")) - 1) < n:
        at = int(space[fits]) + 1 if space[fits] > at else max(fits, at + 1)
        if at >= n:
            break
        starts.append(at)
    return starts


def n_lines(text: str | None, width_um: int, pt: float, bold: bool = False) -> int:
    return len(line_starts(text or "", max(width_um, 1), pt, bold))


def column_widths(header: list[str], rows: list[list[str]], columns: int, width_um: int) -> list[int]:
    """A table's width by the weights of its columns: a twentieth of the mean length, one to three."""
    weights = []
    for c in range(columns):
        cells = [len(r[c] or "") for r in ([header] if header else []) + rows if c < len(r)]
        weights.append(min(3, max(1, sum(cells) // len(cells) // 20)) if cells else 1)
    return [width_um * w // sum(weights) for w in weights]


def row_heights(header: list[str], rows: list[list[str]], columns: int, width_um: int) -> list[int]:
    """Heights of a table's rows, the header first: that of the highest cell, with its padding."""
    widths = column_widths(header, rows, columns, width_um)
    up, side = (round(2000 * x) for x in K.CELL_PADDING)
    line = line_um(K.FONT_SIZES["table"])
    out = []
    for k, row in enumerate(([header] if header else []) + rows):
        bold = k == 0 and bool(header)
        cells = [[x for x in (c or "").splitlines() if x.strip()] or [""] for c in row[:columns]]
        most = max((sum(n_lines(x, w - side, K.FONT_SIZES["table"], bold) for x in parts) for parts, w in zip(cells, widths)), default=1)
        out.append(most * line + up)
    return out


def _code_units(text: str, lang: str | None, columns: int, numbers: bool, badge: bool) -> list[int]:
    """Source line of each visual line of a code block."""
    lines = text.replace("\t", "    ").split("\n")
    gutter = max(2, len(str(len(lines)))) + 3 if numbers and len(lines) >= 2 else 0
    first = max(columns - gutter, 8)
    units = [0] if badge and lang else []
    for k, line in enumerate(lines):
        units += [k] * (1 + max(0, -(-(len(line) - first) // max(first - 2, 1))))
    return units


_MEASURED = "before_um long, heights array<long>, units array<int>, padding_um long, after_um long, moves boolean"


def measured(blocks: DataFrame, *, width_mm: float, font_pt: float = K.BODY_SIZE, numbers: bool = True, badge: bool = True, image_mm: str | None = None) -> DataFrame:
    """Blocks (kind, level, text, lang, depth, tbl) with what :func:`placed` needs.

    image_mm: the column with the height of a picture (null: not loaded, a note stands for
    it; 0: left out).  The last item of a run of list items is told by ``run_ends``, if the
    blocks have that column; otherwise each item ends its run.
    """
    width, body = round(width_mm * 1000), line_um(font_pt)
    columns = max(12, int(max(width_mm - 2 * K.CODE_PADDING_MM, 20.0) / (K.FONT_SIZES["code"] * K.MONO_WIDTH / 1000 * 25.4 / 72) + 1e-9))
    code_line, code_pad = line_um(K.FONT_SIZES["code"], True), round(K.CODE_PADDING_MM * 1000)

    def one(kind, level, text, lang, depth, tbl, image, ends) -> tuple:
        text = text or ""
        before, after = (round(g * body) for g in K.GAPS.get(kind, (0.0, 0.0)))
        lines = lambda pt, room, bold=False: [line_um(pt)] * n_lines(text, room, pt, bold)
        if kind == "title":
            return before, lines(K.TITLE_SIZE, width, True), None, 0, after, False
        if kind == "heading":
            pt = K.HEADING_SIZES[min(max(int(level or 1), 1), len(K.HEADING_SIZES)) - 1]
            return before, lines(pt, width, True), None, 0, after, False
        if kind == "paragraph":
            return before, lines(font_pt, width), None, 0, after, False
        if kind == "caption":
            return before, lines(K.FONT_SIZES["caption"], width), None, 0, after, False
        if kind == "quote":
            up, side = (round(1000 * x) for x in K.QUOTE_PADDING)
            return before, lines(font_pt, width - side), None, up, after, False
        if kind == "list_item":
            room = width - round(1000 * K.LIST_INDENT) * (int(depth or 0) + 1)
            return before, lines(font_pt, max(room, width // 4)), None, 0, after if ends else 0, False
        if kind == "code":
            units = _code_units(text, lang, columns, numbers, badge)
            return before, [code_line] * len(units), units, code_pad, after, True
        if kind == "table" and tbl and tbl["columns"]:
            return before, row_heights(tbl["header"] or [], tbl["rows"] or [], tbl["columns"], width), None, 0, after, False
        if kind == "image" and image is None:
            return 0, [line_um(K.FONT_SIZES["caption"])], None, 0, round(K.GAPS["note"][1] * body), False
        if kind == "image" and image > 0:
            return before, [round(image * 1000)], None, 0, after, False
        if kind == "divider":
            return before, [line_um(K.DIVIDER_SIZE)], None, 0, after, False
        return 0, [], None, 0, 0, False

    names = ["kind", "level", "text", "lang", "depth", "tbl"]
    have = set(blocks.columns)
    empty = {"tbl": "struct<header:array<string>,rows:array<array<string>>,columns:int>", "level": "int", "depth": "int"}
    asked = [blocks[n] if n in have else F.lit(None).cast(empty.get(n, "string")).alias(n) for n in names]
    asked += [(blocks[image_mm] if image_mm else F.lit(None)).cast("double").alias("_image"), (blocks["run_ends"] if "run_ends" in have else F.lit(True)).alias("_ends")]
    kinds = {"before_um": pa.int64(), "heights": pa.list_(pa.int64()), "units": pa.list_(pa.int32()), "padding_um": pa.int64(), "after_um": pa.int64(), "moves": pa.bool_()}
    whole = blocks.select(F.struct(*asked).alias("_asked"), *(blocks[c] for c in blocks.columns if c not in kinds))
    kept = whole.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(*x.values()) for x in batch.column(0).to_pylist()]
            told = [pa.array([f[k] for f in found], t) for k, t in enumerate(kinds.values())]
            yield pa.record_batch([*batch.columns[1:], *told], names=[*kept, *kinds])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema[1:])
    return whole.mapInArrow(run, f"{schema}, {_MEASURED}")


class _Fold:
    """Page and offset after the blocks so far, and how a block changes them."""

    def __init__(self, page_um: int):
        self.page_um, self.page, self.used = page_um, 1, 0

    def gap(self, um: int) -> None:
        self.used = min(self.page_um, self.used + um)

    def turn(self) -> None:
        self.page, self.used = self.page + 1, 0

    def block(self, before: int, heights: list[int], units: list[int] | None, pad: int, after: int, moves: bool) -> tuple[int, int, int, int]:
        """First page, offset there, last page, offset of the block's end."""
        self.gap(before)
        first = None
        total, n = np.concatenate([[0], np.cumsum(np.array(heights, np.int64))]), len(heights)
        if n and moves and total[-1] + 2 * pad > self.page_um - self.used + 500 and total[-1] + 2 * pad <= self.page_um - 1000:
            self.turn()
        starts = [k for k in range(n) if not k or units[k] != units[k - 1]] if units is not None else None
        at = 0
        while at < n:
            room = self.page_um - self.used - 2 * pad
            end = int(np.searchsorted(total, total[at] + max(room, 0), "right")) - 1
            if starts is not None:
                end = page_end(starts, n, at, end - at)
            if end <= at:
                if self.used > 0:
                    self.turn()
                    continue
                end = at + 1  # taller than a page: cut by its end
            first = first or (self.page, self.used)
            self.used = min(self.page_um, self.used + int(total[end] - total[at]) + 2 * pad)
            at = end
            if at < n:
                self.turn()
        first = first or (self.page, self.used)
        last = self.page, self.used
        self.gap(after)
        return *first, *last


def placed(blocks: DataFrame, key: str, *, page_mm: float, order: str = "pos") -> DataFrame:
    """The measured blocks without their pieces, with page, y_um (from the top of the content), last_page and end_um."""
    page_um = round(page_mm * 1000)
    gone = ("before_um", "heights", "units", "padding_um", "after_um", "moves")
    kept = [c for c in blocks.columns if c not in gone]
    dealt = blocks.select(F.struct(*(blocks[c] for c in gone)).alias("_pieces"), *(blocks[c] for c in kept)).repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, of = _Fold(page_um), object()
        for batch in batches:
            found = []
            for owner, x in zip(batch.column(key).to_pylist(), batch.column(0).to_pylist()):
                if owner != of:
                    fold, of = _Fold(page_um), owner
                found.append(fold.block(x["before_um"], x["heights"] or [], x["units"], x["padding_um"], x["after_um"], x["moves"]))
            told = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.int64()))]
            yield pa.record_batch([*batch.columns[1:], *told], names=[*kept, "page", "y_um", "last_page", "end_um"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*kept).schema)
    return dealt.mapInArrow(run, f"{schema}, page int, y_um long, last_page int, end_um long")


def bookmarks(laid: DataFrame, *, page_height_mm: Column, top_mm: Column) -> DataFrame:
    """Titles (level 0) and headings with the page and the height (points from the bottom) that a bookmark leads to."""
    level = F.when(F.col("kind") == "title", F.lit(0)).otherwise(F.col("level"))
    return laid.filter("kind IN ('title', 'heading')").withColumn("level", level).withColumn("top_pt", T.destination_pt(page_height_mm, top_mm + F.col("y_um") / 1000))


def summary(laid: DataFrame, key: str, lines: DataFrame | None = None, missing: DataFrame | None = None) -> DataFrame:
    """Per document: pages, bookmarks, code blocks that a page end breaks, highlighted lines, characters without a glyph.

    lines: its visual lines (key, highlighted); missing: its characters without a glyph (key, ch).
    """
    out = laid.groupBy(key).agg(
        F.max("last_page").alias("pages"), F.count_if(F.col("kind").isin("title", "heading")).alias("bookmarks"), F.count_if((F.col("kind") == "code") & (F.col("last_page") > F.col("page"))).alias("code_splits")
    )
    lit = lines.groupBy(key).agg(F.count_if("highlighted").alias("highlighted_lines")) if lines is not None else out.select(key, F.lit(0).cast("long").alias("highlighted_lines"))
    lost = missing.groupBy(key).agg(F.count_distinct("ch").alias("missing_glyphs")) if missing is not None else out.select(key, F.lit(0).cast("long").alias("missing_glyphs"))
    told = out.join(lit, key, "left").join(lost, key, "left")
    return told.select(key, "pages", "bookmarks", "code_splits", F.coalesce("highlighted_lines", F.lit(0)).alias("highlighted_lines"), F.coalesce("missing_glyphs", F.lit(0)).alias("missing_glyphs"))


# ---- lists


def list_layout(items: DataFrame, key: str = "page_id", *, width_mm: float | None = None) -> DataFrame:
    """Items (key, run, pos, ordered, depth) with bullet, nesting level and indent, run by run in one stream.

    Ordered counters by depth are carried on between sibling lists; an unordered item resets
    those at its depth and below.  A run ends at the first item whose depth fits no open
    level: what follows in it has neither bullet nor level.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, levels, counters, over = None, [], {}, False
        for rows in batches:
            bullets, nested = [], []
            for owner, ordered, depth in zip(zip(rows[key], rows["run"]), rows["ordered"], rows["depth"]):
                if owner != of:
                    of, levels, counters, over = owner, [depth], {}, False
                elif depth > levels[-1]:
                    levels.append(depth)
                else:
                    while levels and levels[-1] > depth:
                        levels.pop()
                    over = over or not levels or levels[-1] != depth
                    levels = levels or [depth]
                if over:
                    bullets.append(None)
                    nested.append(None)
                    continue
                if ordered:
                    counters[depth] = counters.get(depth, 0) + 1
                else:
                    counters = {d: n for d, n in counters.items() if d < depth}
                bullets.append(f"{counters[depth]}." if ordered else "•")
                nested.append(len(levels) - 1)
            yield rows.assign(bullet=pd.Series(bullets, rows.index, object), list_level=pd.Series(nested, rows.index, "Int32"))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    out = items.repartition(key, "run").sortWithinPartitions(key, "run", "pos").mapInPandas(run, f"{kept}, bullet string, list_level int")
    out = out.withColumn("indent_mm", K.LIST_INDENT * (F.col("list_level") + 1))
    return out if width_mm is None else out.withColumn("text_mm", width_mm - F.col("indent_mm"))
