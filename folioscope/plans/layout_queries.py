"""Queries of laid-out documents, each with the SQL that gives the same rows; they join the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import fonts, layout, paint, relational
from folioscope.plans.catalog import _blocks_of, _joined, _page, query
from folioscope.sources.tables import read_table

# ---- code wrapped by measures

_BOXES = {"a4": 174.0, "a5": 124.0, "narrow": 12.0}


@query(
    f"""WITH b(page, mm) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _BOXES.items())}), f(pt) AS (VALUES (9.0::DOUBLE), (16.0)),
       c AS (SELECT page, pt, greatest(12, CAST(floor(greatest(mm - 4, 20) / (pt * 0.6 * 25.4 / 72) + 1e-9) AS INTEGER)) AS columns FROM b, f),
       l AS (SELECT p_partkey, p_size % 3 = 0 AS one, unnest(CASE WHEN p_size % 3 = 0 THEN [{{'i': 0, 'l': repeat(p_type || ' ', 1 + p_size % 9)}}] ELSE [{{'i': 0, 'l': p_name}}, {{'i': 1, 'l': repeat(p_type || ' ', 1 + p_size % 9)}}] END) AS u FROM part),
       w AS (SELECT p_partkey, page, pt, u.i AS unit, u.l AS line, columns, greatest(8, columns - CASE WHEN one THEN 0 ELSE 5 END) AS first FROM l, c),
       n AS (SELECT *, 1 + greatest(0, CAST(ceil((length(line) - first) / greatest(1, first - 2)::DOUBLE) AS BIGINT)) AS parts FROM w)
       SELECT p_partkey, page, pt, CAST(columns AS INTEGER) AS columns, CAST(sum(parts) + max(1 - p_partkey % 2) AS BIGINT) AS n_lines, CAST(max(least(length(line), first)) AS INTEGER) AS widest FROM n GROUP BY ALL"""
)
def code_wrap_plan(spark, sf_dir):
    """Columns of a code box by its width and font, down to the floor, and the visual lines that follow, with a line for the language."""
    last = F.expr("repeat(p_type || ' ', 1 + p_size % 9)")
    text = F.when(F.col("p_size") % 3 == 0, last).otherwise(F.concat("p_name", F.lit("\n"), last))
    blocks = read_table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), F.when(F.col("p_partkey") % 2 == 0, "python").alias("lang"), F.array().cast("array<int>").alias("highlights"))
    boxes = F.broadcast(spark.createDataFrame([(k, v, pt) for k, v in _BOXES.items() for pt in (9.0, 16.0)], "page string, box_mm double, pt double"))
    sized = blocks.crossJoin(boxes).withColumn("columns", relational.max_columns(F.col("box_mm"), F.col("pt")))
    key = ("p_partkey", "page", "pt", "columns")
    lines = relational.visual_lines(sized, key, columns=F.col("columns"), badge=True)
    return lines.groupBy(*key).agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.when(F.col("part") == 0, F.length("text"))).alias("widest"))


# ---- tables


_CELL = "repeat(n_name || ' of ' || n_regionkey || ' ', 1 + (n_nationkey * 7) % 23)"
_ADVANCE = "[" + ", ".join(str(round(w * 9 * 25400 / 72 / 1000)) for w in map(int, layout.K.SANS_WIDTHS.split())) + "]"
_BOLD_ADVANCE = "[" + ", ".join(str(round(w * 9 * 25400 / 72 / 1000)) for w in map(int, layout.K.BOLD_WIDTHS.split())) + "]"


@query(
    f"""WITH RECURSIVE raw AS (SELECT n_regionkey AS t, n_nationkey AS r, unnest([{{'c': 0, 'x': n_name}}, {{'c': 1, 'x': 'no. ' || n_nationkey}}, {{'c': 2, 'x': trim({_CELL})}}]) AS u FROM nation
            UNION ALL SELECT DISTINCT n_regionkey, -1, unnest([{{'c': 0, 'x': 'Nation'}}, {{'c': 1, 'x': 'Number in the list'}}, {{'c': 2, 'x': 'What else there is to say'}}]) FROM nation),
        cells AS (SELECT t, r, u.c AS c, u.x AS x FROM raw),
        weights AS (SELECT t, c, least(3, greatest(1, (CAST(sum(length(x)) AS BIGINT) // count(*)) // 20)) AS w FROM cells GROUP BY t, c),
        widths AS (SELECT t, c, (174000 * w) // CAST(sum(w) OVER (PARTITION BY t) AS BIGINT) - 4000 AS room FROM weights),
        words AS (SELECT t, r, c, room, list_transform(string_split(x, ' '), lambda v: CAST(list_sum(list_transform(string_split(v, ''), lambda k: CASE WHEN r = -1 THEN {_BOLD_ADVANCE} ELSE {_ADVANCE} END[ascii(k) - 31])) AS BIGINT)) AS ws FROM cells JOIN widths USING (t, c)),
        f AS (SELECT t, r, c, room, ws, 1 AS i, 1 AS lines, ws[1] AS used FROM words
            UNION ALL SELECT t, r, c, room, ws, i + 1, lines + CASE WHEN used + {round(278 * 9 * 25400 / 72 / 1000)} + ws[i + 1] > room THEN 1 ELSE 0 END,
                CASE WHEN used + {round(278 * 9 * 25400 / 72 / 1000)} + ws[i + 1] > room THEN ws[i + 1] ELSE used + {round(278 * 9 * 25400 / 72 / 1000)} + ws[i + 1] END FROM f WHERE i < len(ws)),
        n AS (SELECT t, r, c, max(lines) AS lines FROM f GROUP BY t, r, c),
        g AS (SELECT t, r, CAST(max(lines) * 4742 + 2000 AS BIGINT) AS h FROM n GROUP BY t, r)
        SELECT CAST(t AS BIGINT) AS page_id, CAST(row_number() OVER w - 1 AS INTEGER) AS row_no, h AS height_um, CAST(sum(h) OVER w - h AS BIGINT) AS top_um FROM g WINDOW w AS (PARTITION BY t ORDER BY r)"""
)
def table_grid(spark, sf_dir):
    """Rows of the nation tables, with long cells: columns by weight, cells wrapped, rows as high as their highest cell."""
    nation = read_table(spark, sf_dir, "nation")
    row = F.concat(F.lit("<tr><td>"), F.col("n_name"), F.lit("<td>no. "), F.col("n_nationkey").cast("string"), F.lit("<td>"), F.expr(_CELL), F.lit("</tr>"))
    pages = nation.groupBy(F.col("n_regionkey").cast("long").alias("page_id")).agg(_joined(row, F.col("n_nationkey")).alias("rows"))
    html = _page("<table><thead><tr><th>Nation<th>Number in the list<th>What else there is to say</tr></thead><tbody>", F.col("rows"), "</tbody></table>")
    tables = _blocks_of(pages.select("page_id", html.alias("html")), "page_id").filter("kind = 'table'")
    rows = layout.measured(tables, width_mm=174.0).select("page_id", F.posexplode("heights").alias("row_no", "height_um"))
    above = F.sum("height_um").over(Window.partitionBy("page_id").orderBy("row_no"))
    return rows.select("page_id", "row_no", "height_um", (above - F.col("height_um")).alias("top_um"))


# ---- documents

_KINDS = ("heading", "paragraph", "caption", "quote", "list_item", "code", "table", "image", "divider")

#: Blocks of each brand, with pieces of one height; and the steps that put them on pages, one page of one block at a time.
_DOCUMENT_SQL = """
    b AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, p_partkey, p_partkey % 9 AS k, 1 + p_size % 4 AS lv, p_size, 1 + (p_size * 3) % 97 AS w FROM part),
    m AS (SELECT p_brand, i, p_partkey, k, lv,
        CASE k WHEN 0 THEN 2529 WHEN 6 THEN 1265 ELSE 0 END AS before,
        CASE WHEN k = 7 AND p_size % 10 = 0 THEN 1265 WHEN k = 7 AND p_size % 11 = 0 THEN 0 ELSE [1265, 2213, 2213, 2213, 3162, 3162, 3794, 2529, 3162][k + 1] END AS after,
        CASE k WHEN 0 THEN [8958, 7904, 6850, 6323][lv] WHEN 1 THEN 6323 WHEN 2 THEN 4216 WHEN 3 THEN 6323 WHEN 4 THEN 6323 WHEN 5 THEN 4676 WHEN 6 THEN 6742 WHEN 7 THEN CASE WHEN p_size % 10 = 0 THEN 4216 ELSE p_size * 4000 END ELSE 4216 END AS h,
        CASE k WHEN 0 THEN (w + [6, 7, 8, 9][lv]) // [7, 8, 9, 10][lv] WHEN 1 THEN (w + 10) // 11 WHEN 2 THEN (w + 16) // 17 WHEN 3 THEN (w + 9) // 10 WHEN 4 THEN (w + 9) // 10 WHEN 5 THEN w + 1 - p_size % 2 WHEN 6 THEN 1 + p_size % 30
             WHEN 7 THEN CASE WHEN p_size % 11 = 0 AND p_size % 10 <> 0 THEN 0 ELSE 1 END ELSE 1 END AS n,
        CASE k WHEN 3 THEN 4000 WHEN 5 THEN 2000 ELSE 0 END AS pad, k = 5 AS moves, k = 5 AND p_size % 2 = 0 AS badge FROM b),
    f(p_brand, i, entered, line, page, used, p0, y0, done, p1, y1) AS (
        SELECT DISTINCT p_brand, CAST(1 AS BIGINT), false, CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM m
        UNION ALL
        SELECT p_brand, CASE WHEN fin THEN i + 1 ELSE i END, NOT fin, CASE WHEN fin THEN 0 ELSE e END, CASE WHEN turn THEN pg + 1 ELSE pg END,
            CASE WHEN fin THEN least(271000, u2 + after) WHEN turn THEN 0 ELSE u2 END, CASE WHEN e > line OR fin THEN coalesce(p0, pg) ELSE p0 END, CASE WHEN e > line OR fin THEN coalesce(y0, u1) ELSE y0 END, fin, pg, u2
        FROM (SELECT *, e >= n AS fin, e < n AS turn, CASE WHEN e > line THEN least(271000, u1 + (e - line) * h + 2 * pad) ELSE u1 END AS u2 FROM (
            SELECT *, CASE WHEN e0 <= line AND u1 = 0 AND n > 0 THEN line + 1 ELSE e0 END AS e FROM (
            SELECT *, CASE WHEN moves AND n - e1 = 1 AND e1 - line > 1 AND greatest(CASE WHEN badge AND e1 <= 2 THEN 0 ELSE e1 - 1 END, 0) > line THEN CASE WHEN badge AND e1 <= 2 THEN 0 ELSE e1 - 1 END ELSE e1 END AS e0 FROM (
            SELECT *, CASE WHEN line + room >= n THEN n WHEN moves AND badge AND line + room = 1 THEN CASE WHEN line < 1 THEN 1 ELSE line + room END ELSE line + room END AS e1 FROM (
            SELECT *, greatest(0, (271000 - u1 - 2 * pad) // greatest(h, 1)) AS room FROM (
            SELECT *, CASE WHEN jump THEN page + 1 ELSE page END AS pg, CASE WHEN jump THEN 0 ELSE ua END AS u1 FROM (
            SELECT *, NOT entered AND moves AND n > 0 AND n * h + 2 * pad > 271000 - ua + 500 AND n * h + 2 * pad <= 270000 AS jump FROM (
            SELECT f.p_brand, f.i, f.entered, f.line, f.page, CASE WHEN f.done THEN NULL ELSE f.p0 END AS p0, CASE WHEN f.done THEN NULL ELSE f.y0 END AS y0, m.after, m.h, m.n, m.pad, m.moves, m.badge,
                CASE WHEN f.entered THEN f.used ELSE least(271000, f.used + m.before) END AS ua FROM f JOIN m ON m.p_brand = f.p_brand AND m.i = f.i))))))))),
    laid AS (SELECT m.p_brand, m.i, m.p_partkey, m.k, m.lv, m.n, f.p0 AS page, f.y0 AS y_um, f.p1 AS last_page, f.y1 AS end_um FROM f JOIN m ON m.p_brand = f.p_brand AND m.i = f.i - 1 WHERE f.done)"""

def _documents(spark, sf_dir) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    words = 1 + (F.col("p_size") * 3) % 97
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    text = F.when(kind == "code", F.concat(F.expr("repeat('x\\n', (p_size * 3) % 97)"), F.lit("x"))).otherwise(F.trim(F.repeat(F.lit("mmmm "), words.cast("int"))))
    cells = F.array_repeat(F.array(F.lit("x")), (F.col("p_size") % 30).cast("int"))
    image = F.when(F.col("p_size") % 10 == 0, F.lit(None)).when(F.col("p_size") % 11 == 0, 0.0).otherwise(F.col("p_size") * 4.0)
    return part.select(
        "p_brand", "p_partkey", "p_size", kind.alias("kind"), (1 + F.col("p_size") % 4).cast("int").alias("level"), text.alias("text"), F.when(F.col("p_size") % 2 == 0, "python").alias("lang"), F.lit(0).alias("depth"),
        F.struct(F.array(F.lit("x")).alias("header"), cells.alias("rows"), F.lit(1).alias("columns")).alias("tbl"), image.cast("double").alias("image"), F.array((F.col("p_size") % 4).cast("int")).alias("highlights"),
    )


def _laid(spark, sf_dir) -> DataFrame:
    return layout.placed(layout.measured(_documents(spark, sf_dir), width_mm=174.0, image_mm="image"), "p_brand", page_mm=271.0, order="p_partkey")


@query(f"WITH RECURSIVE {_DOCUMENT_SQL} SELECT p_brand, p_partkey, CAST(page AS INTEGER) AS page, y_um, CAST(last_page AS INTEGER) AS last_page, end_um FROM laid")
def document_layout(spark, sf_dir):
    """Page and height of every block of documents with blocks of all kinds."""
    return _laid(spark, sf_dir).select("p_brand", "p_partkey", "page", "y_um", "last_page", "end_um")


@query(f"WITH RECURSIVE {_DOCUMENT_SQL} SELECT p_brand, p_partkey, CAST(lv AS INTEGER) AS level, CAST(page AS INTEGER) AS page, round(greatest(0, least(297, 297 - (10 + y_um / 1000.0))) * 72 / 25.4::DOUBLE, 6) AS top_pt FROM laid WHERE k = 0")
def document_bookmarks(spark, sf_dir):
    """Where the bookmark of every heading leads."""
    marks = layout.bookmarks(_laid(spark, sf_dir), page_height_mm=F.lit(297.0), top_mm=F.lit(10.0))
    return marks.select("p_brand", "p_partkey", "level", "page", F.round("top_pt", 6).alias("top_pt"))


@query(
    f"""WITH RECURSIVE {_DOCUMENT_SQL}, lit AS (SELECT p_brand, count(*) AS n FROM part WHERE p_partkey % 9 = 5 AND p_size % 4 <= (p_size * 3) % 97 GROUP BY p_brand)
        SELECT p_brand, CAST(max(last_page) AS INTEGER) AS pages, count(*) FILTER (k = 0) AS bookmarks, count(*) FILTER (k = 5 AND last_page > page) AS code_splits, coalesce(max(lit.n), 0) AS highlighted_lines,
               count(DISTINCT k = 5) AS missing_glyphs FROM laid LEFT JOIN lit USING (p_brand) GROUP BY p_brand"""
)
def document_summary(spark, sf_dir):
    """The numbers of a rendered document in one row: pages, bookmarks, broken code blocks, highlighted lines, characters without a glyph."""
    documents = _documents(spark, sf_dir)
    lines = relational.visual_lines(documents.filter("kind = 'code'"), ("p_brand", "p_partkey"), columns=80, badge=True)
    # a font without m and x
    chars = documents.select("p_brand", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).filter("ch IN ('m', 'x')")
    return layout.summary(_laid(spark, sf_dir), "p_brand", lines, chars)


# ---- fonts

#: (font, first and last code point): fonts that overlap, none of which has all.
_RANGES = [("sans", 0x20, 0x7E), ("sans", 0xE0, 0xEF), ("mono", 0x20, 0x7E), ("fallback", 0xE8, 0xF6), ("fallback", 0xE8, 0xEA), ("fallback", 0x100, 0x2FF)]


def _ranges(spark) -> DataFrame:
    return spark.createDataFrame(_RANGES, "font string, lo int, hi int")


def _in(font: str, ch: str = "ch") -> str:
    return "(" + " OR ".join(f"unicode({ch}) BETWEEN {lo} AND {hi}" for f, lo, hi in _RANGES if f == font) + ")"


_DRAWN = r"NOT regexp_matches(ch, '^[\s\x{00}-\x{20}\x{7F}-\x{A0}\x{AD}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{FEFF}]$')"


@query(
    f"""WITH c AS (SELECT doc_id, unnest(list_distinct(string_split(text, ''))) AS ch FROM documents), d AS (SELECT * FROM c WHERE ch <> '' AND {_DRAWN} AND NOT {_in('sans')})
        SELECT doc_id, coalesce(string_agg(ch, '' ORDER BY unicode(ch)) FILTER ({_in('fallback')}), '') AS falls, coalesce(string_agg(ch, '' ORDER BY unicode(ch)) FILTER (NOT {_in('fallback')}), '') AS missing FROM d GROUP BY doc_id"""
)
def font_plans(spark, sf_dir):
    """Of each document the characters that go to the fallback font, and those that no font has."""
    plan = fonts.font_plan(read_table(spark, sf_dir, "documents"), "doc_id", _ranges(spark), main="sans", fallback="fallback")
    return plan.select("doc_id", F.array_join("falls", "").alias("falls"), F.array_join("missing", "").alias("missing"))


@query(
    f"""WITH d AS (SELECT DISTINCT ch FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '')
        SELECT ch, array_to_string(list_filter([CASE WHEN {_in('fallback')} THEN 'fallback' END, CASE WHEN {_in('mono')} THEN 'mono' END, CASE WHEN {_in('sans')} THEN 'sans' END], lambda x: x IS NOT NULL), ',') AS fonts
        FROM d WHERE {_in('fallback')} OR {_in('mono')} OR {_in('sans')}"""
)
def font_coverage(spark, sf_dir):
    """Which of three fonts have each character of the documents."""
    chars = relational.charset(read_table(spark, sf_dir, "documents"), "doc_id").select("ch")
    return fonts.fonts_of(chars, _ranges(spark)).select("ch", F.array_join("fonts", ",").alias("fonts"))


@query(
    f"""WITH c AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS place, text FROM documents),
        d AS (SELECT doc_id, place - 1 AS place, {_DRAWN} AND NOT {_in('sans')} AND {_in('fallback')} AS f FROM (SELECT doc_id, place, text[place] AS ch FROM c)),
        g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) - row_number() OVER (PARTITION BY doc_id, f ORDER BY place) AS g FROM d),
        r AS (SELECT doc_id, f, min(place) AS s, count(*) AS n FROM g GROUP BY doc_id, f, g)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) AS INTEGER) AS run, f AS needs_fallback, CAST(s AS INTEGER) AS start, CAST(n AS INTEGER) AS n_chars FROM r"""
)
def font_runs(spark, sf_dir):
    """Documents cut into runs for the main font and for the one that stands in for it."""
    return fonts.text_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", _ranges(spark), main="sans", fallback="fallback")


# ---- painting

_PT = "(72 / 25.4::DOUBLE)"


def _n(x: str) -> str:
    return f"printf('%.2f', {x})"


def _path(x: str, y: str, w: str, h: str, left: str, right: str) -> str:
    """A rounded outline as SQL; radii that fit."""
    x1, y1, c = f"({x} + {w})", f"({y} + {h})", "0.5523::DOUBLE"
    line = lambda *p: " || ' ' || ".join(map(_n, p))
    arc = lambda r, *p: f"CASE WHEN {r} > 0 THEN chr(10) || {line(*p)} || ' c' ELSE '' END"
    return " || ".join(
        [
            f"{line(f'{x} + {left}', y)} || ' m' || chr(10)", f"{line(f'{x1} - {right}', y)} || ' l'", arc(right, f"{x1} - {right} + {c} * {right}", y, x1, f"{y} + {right} - {c} * {right}", x1, f"{y} + {right}"),
            f"chr(10) || {line(x1, f'{y1} - {right}')} || ' l'", arc(right, x1, f"{y1} - {right} + {c} * {right}", f"{x1} - {right} + {c} * {right}", y1, f"{x1} - {right}", y1),
            f"chr(10) || {line(f'{x} + {left}', y1)} || ' l'", arc(left, f"{x} + {left} - {c} * {left}", y1, x, f"{y1} - {left} + {c} * {left}", x, f"{y1} - {left}"),
            f"chr(10) || {line(x, f'{y} + {left}')} || ' l'", arc(left, x, f"{y} + {left} - {c} * {left}", f"{x} + {left} - {c} * {left}", y, f"{x} + {left}", y), "chr(10) || 'h'",
        ]
    )


_RADIUS = f"(1.0::DOUBLE * {_PT})"


@query(
    f"""WITH RECURSIVE {_DOCUMENT_SQL}, one AS (SELECT * FROM laid WHERE page = last_page AND n > 0),
        pages AS (SELECT DISTINCT p_brand, page FROM one),
        r AS (SELECT p_brand, page, p_partkey, 18.3 * {_PT} AS x, (297 - (10 + y_um / 1000.0::DOUBLE) - (end_um - y_um) / 1000.0::DOUBLE) * {_PT} AS y, 174.1 * {_PT} AS w, (end_um - y_um) / 1000.0::DOUBLE * {_PT} AS h FROM one WHERE k = 5),
        l AS (SELECT p_brand, page, p_partkey, 20.3 * {_PT} AS x, (297 - (12 + y_um / 1000.0::DOUBLE) - 4.676::DOUBLE) * {_PT} AS y, 170.1 * {_PT} AS w, 4.676::DOUBLE * {_PT} AS h FROM one WHERE k = 5),
        ops AS (
            SELECT p_brand, page, 0 AS layer, 0 AS n, 'q 0.1255 0.1333 0.1451 rg 0 0 ' || {_n(f"210 * {_PT}")} || ' ' || {_n(f"297 * {_PT}")} || ' re f Q' AS op FROM pages WHERE page % 3 <> 0
            UNION ALL SELECT p_brand, page, 1, p_partkey, 'q' || chr(10) || '1.0000 1.0000 1.0000 rg 0.0000 0.0000 0.0000 RG 0.80 w' || chr(10) || {_path('x', 'y', 'w', 'h', _RADIUS, _RADIUS)} || chr(10) || 'B' || chr(10) || '1.0000 0.0000 0.0000 rg' || chr(10)
                || {_path('x', 'y', f'(1.1 * {_PT})', 'h', _RADIUS, '0.0::DOUBLE')} || chr(10) || 'f' || chr(10) || 'Q' FROM r
            UNION ALL SELECT p_brand, page, 2, p_partkey, 'q' || chr(10) || '1.0000 1.0000 0.0000 rg' || chr(10) || {_n('x')} || ' ' || {_n('y')} || ' ' || {_n('w')} || ' ' || {_n('h')} || ' re' || chr(10) || 'f' || chr(10) || 'Q' FROM l
            UNION ALL SELECT p_brand, page, 3, p_partkey, 'BT ' || p_partkey || ' ET' FROM one)
        SELECT p_brand, CAST(page AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY p_brand, page ORDER BY layer, n, op) AS INTEGER) AS op_no, CAST(layer AS INTEGER) AS layer, op FROM ops"""
)
def page_operations(spark, sf_dir):
    """What is painted on the pages of the documents, in order: backgrounds, boxes, bands, texts; blocks that a page end breaks are left to other queries."""
    one = _laid(spark, sf_dir).filter("page = last_page AND NOT (kind = 'image' AND coalesce(image, 1) = 0)")
    top = 10 + F.col("y_um") / 1000
    number = F.col("p_partkey").alias("n")
    pages = one.select("p_brand", "page").distinct().select("p_brand", "page", F.lit(210.0).alias("width_mm"), F.lit(297.0).alias("height_mm"), F.when(F.col("page") % 3 != 0, "202225").alias("colour"))
    code = one.filter("kind = 'code'")
    boxes = code.select("p_brand", "page", number, F.lit(18.3).alias("x_mm"), top.alias("y_mm"), F.lit(174.1).alias("width_mm"), ((F.col("end_um") - F.col("y_um")) / 1000).alias("height_mm"), F.lit("FFFFFF").alias("fill"), F.lit("000000").alias("border"), F.lit("FF0000").alias("accent"))
    bands = code.select("p_brand", "page", number, F.lit(20.3).alias("x_mm"), (top + 2).alias("y_mm"), F.lit(170.1).alias("width_mm"), F.lit(4.676).alias("height_mm"), F.lit("FFFF00").alias("colour"))
    texts = one.select("p_brand", "page", number, F.concat(F.lit("BT "), F.col("p_partkey").cast("string"), F.lit(" ET")).alias("op"))
    return paint.operations(pages, boxes, bands, texts, "p_brand")


@query(
    """WITH RECURSIVE r AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rect, CAST(l_quantity AS BIGINT) % 7 AS budget, l_partkey AS p FROM lineitem),
        s AS (SELECT doc, rect, budget, k, (p + 3 * k) % 4 AS glyphs, (p + k) % 5 <> 4 AND glyphs > 0 AS near FROM (SELECT *, unnest(range(0, 5)) AS k FROM r)),
        f AS (SELECT doc, rect, CAST(-1 AS BIGINT) AS k, budget AS rest, false AS hit FROM r
              UNION ALL SELECT f.doc, f.rect, s.k, rest - CASE WHEN near AND glyphs <= rest THEN glyphs ELSE 0 END, near AND glyphs <= rest FROM f JOIN s ON s.doc = f.doc AND s.rect = f.rect AND s.k = f.k + 1)
        SELECT doc, CAST(rect * 10 + k AS BIGINT) AS n, CASE WHEN hit THEN CAST(rect AS BIGINT) END AS rect FROM f WHERE k >= 0"""
)
def copied_texts(spark, sf_dir):
    """Texts at and beside the rectangles of line numbers: hits at the edges, near misses, and budgets that run out."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.row_number().over(order).cast("long").alias("rect"), (F.col("l_quantity").cast("long") % 7).alias("glyphs"), F.col("l_partkey").alias("p"))
    rects = rows.select("doc", "page", "rect", F.lit(50.0).alias("x"), (F.col("rect") * 40.0).alias("y"), F.lit(20.0).alias("width"), F.lit(11.0).alias("height"), "glyphs")
    shows = rows.select("doc", "page", "rect", "p", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    at = ((F.col("p") + F.col("k")) % 5).cast("int") + 1
    # inside; just within the tolerance at each edge; beyond it
    x = F.element_at(F.array(*map(F.lit, (55.0, 49.25, 70.75, 60.0, 71.0))), at)
    y = F.col("rect") * 40.0 + F.element_at(F.array(*map(F.lit, (3.0, 0.0, 11.75, -0.75, 5.0))), at)
    texts = shows.select("doc", "page", (F.col("rect") * 10 + F.col("k")).alias("n"), x.alias("x"), y.alias("y"), ((F.col("p") + 3 * F.col("k")) % 4).alias("glyphs"))
    return paint.hidden_texts(texts, rects).select("doc", "n", "rect")
