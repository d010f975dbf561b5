"""Relational operators over blocks, outlines, images and characters: windows, joins and sets."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import constants as K
from folioscope.functions import text as T


def trim_dividers(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Blocks without leading and trailing dividers."""
    w = Window.partitionBy(key)
    solid = F.when(F.col("kind") != "divider", F.col("pos"))
    return blocks.withColumn("_lo", F.min(solid).over(w)).withColumn("_hi", F.max(solid).over(w)).filter("pos BETWEEN _lo AND _hi").drop("_lo", "_hi")


def collapse_images(images: DataFrame, key: str = "page_id") -> DataFrame:
    """First row of each address, with the alternative text of most bytes (the first of equals)."""
    w = Window.partitionBy(key, "img_url")
    best = F.max_by("alt", F.struct(F.octet_length("alt"), -F.col("pos"))).over(w)
    return images.withColumn("alt", best).withColumn("_n", F.row_number().over(w.orderBy("pos"))).filter("_n = 1").drop("_n")


def list_runs(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """List items numbered by their maximal run of neighbouring list items."""
    return blocks.filter("kind = 'list_item'").withColumn("_run", F.col("pos") - F.row_number().over(Window.partitionBy(key).orderBy("pos"))).withColumn("run", F.dense_rank().over(Window.partitionBy(key).orderBy("_run")).cast("int")).drop("_run")


def outline(headings: DataFrame, key: str) -> DataFrame:
    """Parent, neighbours and descendants of headings (key, idx from 0, title, level).

    The parent is the nearest heading before with a smaller level; descendants reach up to
    the next heading of the same or a smaller level.
    """
    ahead, back = Window.partitionBy(key).orderBy("idx"), Window.partitionBy(key).orderBy(F.desc("idx"))
    rest = F.count(F.lit(1)).over(Window.partitionBy(key))
    # levels are six: the last (next) heading of each level is a running maximum (minimum)
    seen = lambda fold, w, n: fold(F.when(F.col("level") == n, F.col("idx"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fits = lambda k, n, holds: F.when(holds, F.col(f"_{k}{n}"))
    rows = headings.select("*", rest.alias("_n"), *(seen(F.max, ahead, n).alias(f"_b{n}") for n in range(1, 7)), *(seen(F.min, back, n).alias(f"_a{n}") for n in range(1, 7)))
    parent = F.greatest(*(fits("b", n, F.col("level") > n) for n in range(1, 7)))
    end = F.coalesce(F.least(*(fits("a", n, F.col("level") >= n) for n in range(1, 7))), F.col("_n"))
    rows = rows.withColumn("parent_idx", parent).withColumn("n_descendants", (end - F.col("idx") - 1).cast("int")).drop("_n", *(f"_{k}{n}" for k in "ab" for n in range(1, 7)))
    s = Window.partitionBy(key, "parent_idx").orderBy("idx")
    return rows.withColumn("prev_idx", F.lag("idx").over(s)).withColumn("next_idx", F.lead("idx").over(s))


def outline_roots(tree: DataFrame, key: str) -> DataFrame:
    """Of each outline its roots, and the count written at its top: roots and all their descendants."""
    roots = tree.filter("parent_idx IS NULL")
    return roots.groupBy(key).agg(F.count(F.lit(1)).alias("n_roots"), F.sum(F.col("n_descendants") + 1).alias("n_entries"))


def column_weights(tables: DataFrame, key: str) -> DataFrame:
    """Weight 1 to 3 of each table column: mean cell length over 20, header cells included."""
    lines = F.concat(F.when(F.size("tbl.header") > 0, F.array("tbl.header")).otherwise(F.array().cast("array<array<string>>")), F.col("tbl.rows"))
    cells = tables.select(key, F.explode(lines).alias("cells")).select(key, F.posexplode("cells").alias("col", "cell"))
    mean = F.floor(F.floor(F.sum(F.length("cell")) / F.count(F.lit(1))) / 20)
    return cells.groupBy(key, "col").agg(F.greatest(F.lit(1), F.least(F.lit(3), mean)).cast("int").alias("weight"))


# ---- characters


def interface_charset(spark: SparkSession) -> DataFrame:
    """Characters that page furniture may use whatever a document holds."""
    return spark.createDataFrame([(c,) for c in sorted(set(K.INTERFACE_TEXT))], "ch string")


def charset(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Distinct characters of each text."""
    return rows.select(key, F.explode(F.array_distinct(F.split(F.col(text), ""))).alias("ch")).filter("ch <> ''")


def needs_glyph(ch: Column) -> Column:
    """Characters that are drawn: not white space, control or invisible."""
    return ~ch.rlike(rf"(?U)^(?:\s|\p{{Cntrl}}|{T.INVISIBLE})$")


def missing_glyphs(chars: DataFrame, coverage: DataFrame) -> DataFrame:
    """Drawn characters that the coverage (a column ``ch``) does not have."""
    return chars.filter(needs_glyph(F.col("ch"))).join(coverage.select("ch"), "ch", "left_anti")


def coverage_runs(rows: DataFrame, key: str, covered: str, text: str = "text") -> DataFrame:
    """Maximal runs of characters that do, or do not, need the fallback font.

    covered: the inside of a character class, of what the main font has.  A pattern cuts
    each row into its runs; only runs, not characters, are put in order.
    """
    falls = rf"[^{covered}\s\p{{Cntrl}}{T.INVISIBLE[1:-1]}]"
    keeps = rf"[{covered}\s\p{{Cntrl}}{T.INVISIBLE[1:-1]}]"
    runs = rows.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(rf"(?U)(?:{falls})++|(?:{keeps})++"), F.lit(0))).alias("at", "run_text"))
    w = Window.partitionBy(key).orderBy("at")
    start = F.coalesce(F.sum(F.length("run_text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return runs.select(key, (F.col("at") + 1).alias("run"), F.rlike(F.substring("run_text", 1, 1), F.lit(rf"(?U)^{falls}")).alias("needs_fallback"), start.cast("int").alias("start"), F.length("run_text").alias("n_chars"))


# ---- filter rules


def parse_rules(lines: DataFrame, column: str = "raw") -> DataFrame:
    """Network rules of a filter list: kind (host, text), pattern, exception, resource types.

    Understood: ``||host^``, ``||host/path``, plain substrings, ``@@`` exceptions and
    ``$type`` options; comments, cosmetic rules and blank lines are left out.
    """
    raw = F.trim(F.col(column))
    body = F.regexp_replace(raw, "^@@", "")
    rule = F.substring_index(body, "$", 1)
    types = F.when(F.instr(body, "$") > 0, F.filter(F.split(F.substring_index(body, "$", -1), ","), lambda t: t.isin("image", "script", "stylesheet", "subdocument"))).otherwise(F.array().cast("array<string>"))
    is_host = rule.rlike(r"^\|\|[A-Za-z0-9.-]+\^?$")
    pattern = F.regexp_replace(F.regexp_replace(F.regexp_replace(rule, r"^\|\|", ""), r"^\||\|$", ""), r"\^$", "")
    return lines.filter((raw != "") & ~raw.rlike(r"^!|^\[|##|#@#")).select(
        raw.alias("raw"), raw.startswith("@@").alias("is_exception"), F.when(is_host, "host").otherwise("text").alias("kind"), F.lower(pattern).alias("pattern"), types.alias("types")
    )


def host_suffixes(url: Column) -> Column:
    """The host of an address and its parent domains, each once."""
    labels = F.split(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"\.")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))


MAX_TEXT_RULES = 500


#: Characters by which longer substring rules meet addresses.
GRAM = 6


def _contained(keys: DataFrame, residue: DataFrame, url: str) -> DataFrame:
    """Addresses that hold a pattern, by an equi-join: a pattern's last characters are among an address's grams."""
    sizes = [r[0] for r in residue.select(F.least(F.length("pattern"), F.lit(GRAM)).alias("n")).filter("n > 0").distinct().collect()]
    low = F.lower(F.col(url))

    def grams_of(n: int) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda k: F.substring(low, k, F.lit(n)))
        return F.when(F.length(low) >= n, pieces).otherwise(F.array().cast("array<string>"))

    grams = F.concat(*map(grams_of, sizes or [1]))
    cut = residue.withColumn("gram", F.right("pattern", F.least(F.length("pattern"), F.lit(GRAM))))
    return keys.select(url, F.explode(F.array_distinct(grams)).alias("gram")).join(cut, "gram").filter(low.contains(F.col("pattern"))).select(url)


def _hits(requests: DataFrame, rules: DataFrame, url: str, resource: str) -> DataFrame:
    fits = (F.size("types") == 0) | F.array_contains("types", F.lit(resource))
    fitting = rules.filter(fits)
    keys = requests.select(url).distinct()
    by_host = keys.select(url, F.explode(host_suffixes(F.col(url))).alias("pattern")).join(fitting.filter("kind = 'host'").select("pattern").distinct(), "pattern").select(url)
    # substring rules are a small residue; they are broadcast only while they number at most MAX_TEXT_RULES
    residue = fitting.filter("kind = 'text' AND pattern <> ''").select("pattern").distinct()
    few = residue.limit(MAX_TEXT_RULES + 1).count() <= MAX_TEXT_RULES
    by_text = keys.join(F.broadcast(residue), F.lower(url).contains(F.col("pattern"))).select(url) if few else _contained(keys, residue, url)
    return by_host.union(by_text).distinct()


def blocked_urls(requests: DataFrame, rules: DataFrame, *, url: str = "img_url", resource: str = "image") -> DataFrame:
    """Addresses that a blocking rule matches and no exception does; host rules match by equi-join."""
    hit = _hits(requests, rules.filter("NOT is_exception"), url, resource)
    return hit.join(_hits(hit, rules.filter("is_exception"), url, resource), url, "left_anti")


def allowed(blocks: DataFrame, rules: DataFrame, *, url: str = "img_url") -> DataFrame:
    """Blocks without the images that the rules block."""
    return blocks.join(blocked_urls(blocks.filter(F.col(url).isNotNull()), rules, url=url), url, "left_anti")


# ---- images


def image_outcomes(responses: DataFrame) -> DataFrame:
    """url, content_type, body: format, pixels and outcome of each image."""
    kind = F.coalesce(T.format_from_content_type(F.coalesce("content_type", F.lit(""))), T.sniff_format(F.col("body")), F.lit("png"))
    rows = responses.withColumn("format", kind).withColumn("_s", T.image_size(F.col("body")))
    # drawings count as they are rasterized
    scale = F.when(F.col("format") == "svg", T.raster_scale(F.col("width_px"), F.col("height_px")))
    drawn = lambda side: F.when(scale.isNull(), F.col(side)).otherwise(T.raster_pixels(F.col(side), scale))
    small = (drawn("width_px") < K.MIN_IMAGE_PIXELS) | (drawn("height_px") < K.MIN_IMAGE_PIXELS)
    rows = rows.withColumn("width_px", F.col("_s.width")).withColumn("height_px", F.col("_s.height")).drop("_s")
    failed = F.when(~F.col("url").rlike("^https?://"), "unsupported").when(F.col("body").isNull() | (F.length("body") == 0), "network").when(F.col("width_px").isNull(), "decode")
    return rows.withColumn("reason", failed).withColumn("outcome", F.when(failed.isNotNull(), "failed").when(small, "skipped").otherwise("loaded"))


def prepared_images(outcomes: DataFrame, max_width_mm: Column, max_height_mm: Column) -> DataFrame:
    """Loaded images with the pixels they are printed from, their resolution, the factor that fits them, and their size on paper.

    A drawing is rasterized beyond its own pixels, and its resolution grows alike, so its size on paper is the same.
    """
    scale = F.when(F.col("format") == "svg", T.raster_scale(F.col("width_px"), F.col("height_px")).cast("double"))
    px = lambda side: F.when(scale.isNull(), F.col(side)).otherwise(T.raster_pixels(F.col(side), scale))
    rows = outcomes.filter("outcome = 'loaded'").withColumns({"print_width_px": px("width_px"), "print_height_px": px("height_px"), "dpi": 96.0 * F.coalesce(scale, F.lit(1.0))})
    wide, high = T.natural_mm(F.col("print_width_px"), F.col("dpi")), T.natural_mm(F.col("print_height_px"), F.col("dpi"))
    return rows.withColumn("fit", T.fit_scale(wide, high, max_width_mm, max_height_mm)).withColumns({"width_mm": wide * F.col("fit"), "height_mm": high * F.col("fit")})


def with_outcome(blocks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Image blocks with their outcome; one without a response failed in the network."""
    known = outcomes.select(F.col("url").alias("_u"), "outcome", "reason")
    return blocks.join(known, F.col("img_url") == F.col("_u"), "left").drop("_u").withColumn("reason", F.when(F.col("outcome").isNull(), "network").otherwise(F.col("reason"))).withColumn("outcome", F.coalesce("outcome", F.lit("failed")))


def prefetch_urls(blocks: DataFrame) -> DataFrame:
    """Addresses to fetch: each once, none empty, in order."""
    return blocks.filter("img_url <> ''").select("img_url").distinct().orderBy("img_url")


def image_counters(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Of image blocks with their outcome: loaded, skipped, failed, and loaded drawings (which are rasterized)."""
    is_ = lambda what: F.col("outcome") == what
    return blocks.groupBy(key).agg(*(F.count_if(is_(k)).alias(k) for k in ("loaded", "skipped", "failed")), F.count_if(is_("loaded") & (F.col("format") == "svg")).alias("rasterized"))


# ---- layout


def block_styles(blocks: DataFrame) -> DataFrame:
    """Blocks with their font size (pt), whether their font is monospaced, bold or italic, and whether they make a bookmark."""
    kind, level = F.col("kind"), F.col("level")
    size = F.when(kind == "heading", F.element_at(F.array(*map(F.lit, K.HEADING_SIZES)), F.least(level, F.lit(len(K.HEADING_SIZES)))))
    for k, pt in K.FONT_SIZES.items():
        size = size.when(kind == k, F.lit(pt))
    return blocks.withColumns({"font_pt": size, "mono": kind == "code", "bold": kind == "heading", "italic": kind.isin("quote", "caption"), "bookmark": kind == "heading"})


def copy_texts(lines: DataFrame) -> DataFrame:
    """Visual lines with what a reader copies: no line numbers, continuation marks or badges."""
    return lines.withColumn("copy_text", F.col("text")).withColumn("shown_text", F.concat("marker", "text"))


def kind_runs(chars: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Neighbouring pieces of a line that are of one kind as one (keys, tok_no, kind, text)."""
    w = Window.partitionBy(*key).orderBy("tok_no")
    group = F.sum((F.coalesce(F.lag("kind").over(w), F.lit("")) != F.col("kind")).cast("int")).over(w)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_no", "text"))), lambda x: x["text"]), "")
    return chars.withColumn("_g", group).groupBy(*key, "_g").agg(F.min("tok_no").alias("tok_no"), F.first("kind").alias("kind"), text.alias("text")).drop("_g")


def font_families(chars: DataFrame, covered: DataFrame, blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Which fonts a document takes: sans always, mono with code, the fallback where a drawn character is uncovered."""
    missing = missing_glyphs(chars, covered).groupBy(key).agg(F.count(F.lit(1)).alias("n_missing"))
    mono = blocks.groupBy(key).agg(F.bool_or(F.col("kind") == "code").alias("mono"))
    return mono.join(missing, key, "left").select(key, F.lit(True).alias("sans"), "mono", (F.coalesce("n_missing", F.lit(0)) > 0).alias("fallback"))


def missing_union(chars: DataFrame, *coverages: DataFrame) -> DataFrame:
    """Drawn characters that any of several fonts lacks, each once."""
    out = missing_glyphs(chars, coverages[0])
    for c in coverages[1:]:
        out = out.union(missing_glyphs(chars, c))
    return out.distinct()


def page_end(starts: list[int], total: int, at: int, room: int) -> int:
    """Where the page ends that begins with line ``at`` and has room for so many lines.

    starts: the first line of each unit (a source line with its wraps), in order.  Pages end
    between units; a unit longer than a page is cut.  If a single line would be left for the
    next page, the last unit here goes with it, as long as another one stays.
    """
    limit = at + max(room, 0)
    if limit >= total:
        return total
    end = starts[bisect_right(starts, limit) - 1]
    if end <= at:
        end = limit
    if total - end == 1 and end - at > 1:
        last = starts[bisect_left(starts, end) - 1]
        end = last if last > at else end
    return end


def unit_starts(units: list[int]) -> list[int]:
    return [k for k, u in enumerate(units) if not k or units[k - 1] != u]


def page_lines(units: list[int], at: int, available: float, height: float) -> int:
    """How many lines from ``at`` fit on a page; units: the unit of each line."""
    if at >= len(units) or height <= 0:
        return 0
    return page_end(unit_starts(units), len(units), at, int(available // height)) - at


def paginate(lines: DataFrame, key: str, *, first_mm: float, page_mm: float, line_mm: float, padding_mm: float = K.CODE_PADDING_MM) -> DataFrame:
    """(key, vline_no, unit) with page and offset of each line of a code block; blocks move on whole if they can.

    The box around the lines has its padding above and below on every page.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vline_no")
        starts, total = unit_starts(rows["unit"].tolist()), len(rows)
        whole = total * line_mm + 2 * padding_mm
        moves = whole > first_mm + 0.5 and whole <= page_mm - 1
        at, page, room, pages, tops = 0, int(moves), page_mm if moves else first_mm, [], []
        while at < total:
            end = page_end(starts, total, at, int((room - 2 * padding_mm) // line_mm))
            if end == at and room >= page_mm:
                end = at + 1
            pages += [page] * (end - at)
            tops += [page_mm - room + padding_mm + k * line_mm for k in range(end - at)]
            at, page, room = end, page + 1, page_mm
        return rows.assign(page_no=pages, y_mm=tops)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    return lines.groupBy(key).applyInPandas(run, f"{kept}, page_no int, y_mm double")


def code_boxes(placed: DataFrame, key: str, *, line_mm: float, padding_mm: float = K.CODE_PADDING_MM) -> DataFrame:
    """The box behind a code block on each of its pages, and on which pages it goes on from the one before."""
    top, bottom = F.min("y_mm") - padding_mm, F.max("y_mm") + line_mm + padding_mm
    per_page = placed.groupBy(key, "page_no").agg(top.alias("top_mm"), bottom.alias("bottom_mm"), F.count(F.lit(1)).alias("n_lines"), F.min("vline_no").alias("first_line"))
    return per_page.withColumn("continued", F.min("page_no").over(Window.partitionBy(key)) < F.col("page_no"))


def code_splits(boxes: DataFrame, key: str) -> DataFrame:
    """How often a block is broken by the end of a page."""
    return boxes.groupBy(key).agg(F.count_if("continued").alias("code_splits"))


def highlight_bands(placed: DataFrame, key: str, *, line_mm: float) -> DataFrame:
    """The band behind each visual line that is highlighted; neighbours have bands of their own."""
    return placed.filter("highlighted").select(key, "page_no", "vline_no", F.col("y_mm").alias("top_mm"), (F.col("y_mm") + line_mm).alias("bottom_mm"))


def max_columns(box_mm: Column, font_pt: Column) -> Column:
    """How many characters of the mono font a line of a code box holds: twelve at least, in a box of twenty mm at least."""
    advance_mm = font_pt * F.lit(K.MONO_WIDTH / 1000 * 25.4 / 72)
    return F.greatest(F.floor(F.greatest(box_mm - 2 * K.CODE_PADDING_MM, F.lit(20.0)) / advance_mm + 1e-9), F.lit(12)).cast("int")


def visual_lines(blocks: DataFrame, key: tuple[str, ...], *, columns: int | Column, numbers: bool = True, badge: bool = False) -> DataFrame:
    """Code blocks wrapped into visual lines with their gutter marks; all native.

    columns may be a column of the blocks.  badge: a block of a known language begins with a
    line that names it; the line belongs to the first source line.
    """
    columns = columns if isinstance(columns, Column) else F.lit(columns)
    lang = F.col("lang") if badge else F.lit(None).cast("string")
    lines = blocks.select(*key, "highlights", columns.alias("_columns"), lang.alias("_lang"), F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\t"), F.lit("    ")), "\n").alias("ls"))
    n = F.size("ls")
    numbered = F.lit(numbers) & (n >= 2)
    digits = F.greatest(F.lit(2), F.length(n.cast("string")))
    width = F.greatest(F.col("_columns") - F.when(numbered, digits + 3).otherwise(F.lit(0)), F.lit(8))
    rows = lines.select(*key, numbered.alias("numbered"), digits.alias("digits"), width.alias("width"), "_lang", "highlights", F.posexplode("ls").alias("unit", "line"))
    rows = rows.select(*key, "numbered", "digits", "unit", "_lang", F.coalesce(F.array_contains("highlights", F.col("unit")), F.lit(False)).alias("highlighted"), F.posexplode(T.visual_chunks(F.col("line"), F.col("width"), F.col("width") - 2)).alias("part", "text"))
    marker = T.gutter_marker(F.col("unit") + 1, F.col("digits"), F.col("part") > 0, F.col("numbered"))
    kept = ["unit", "part", "marker", "text", "highlighted"]
    rows = rows.select(*key, "_lang", "unit", "part", marker.alias("marker"), "text", "highlighted")
    if badge:
        named = rows.filter("unit = 0 AND part = 0 AND _lang IS NOT NULL").select(*key, F.lit(0).alias("unit"), F.lit(-1).alias("part"), F.lit("").alias("marker"), F.col("_lang").alias("text"), F.lit(False).alias("highlighted"))
        rows = rows.select(*key, *kept).union(named)
    order = Window.partitionBy(*key).orderBy("unit", "part")
    return rows.select(*key, (F.row_number().over(order) - 1).alias("vline_no"), *kept)


# ---- translation


def translation_jobs(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per text to translate: block texts, and table cells by row and column (header is row 0)."""
    none = F.lit(None).cast("int")
    texts = blocks.filter(F.col("kind").isin("paragraph", "heading", "caption", "quote", "list_item")).select(key, "pos", "kind", none.alias("row"), none.alias("col"), "text")
    cells = blocks.filter("kind = 'table'").select(key, "pos", "kind", F.posexplode(F.concat(F.array("tbl.header"), "tbl.rows")).alias("row", "cells")).select(key, "pos", "kind", "row", F.posexplode("cells").alias("col", "text"))
    return texts.unionByName(cells)


def translate_jobs(jobs: DataFrame, translate: Callable[[Column], Column], *, most: int = 3000) -> DataFrame:
    """Jobs with ``translated``: protected pieces masked, chunks translated by a column over ``x``, restored or left."""
    rows = jobs.withColumn("_p", T.protect(F.col("text"))).withColumn("_c", T.chunk_text(F.col("_p.masked"), most)).withColumn("n_chunks", F.size("_c"))
    joined = F.array_join(F.transform("_c", lambda x: translate(x)), " ")
    done = F.when(F.trim("text") == "", F.col("text")).otherwise(F.coalesce(T.restore(joined, F.col("_p.parts")), F.col("text")))
    return rows.withColumn("translated", done).drop("_p", "_c")


def title_jobs(articles: DataFrame, key: str = "page_id") -> DataFrame:
    """A job for the title of each article, in the form of the others (pos -1)."""
    none = F.lit(None).cast("int")
    return articles.select(key, F.lit(-1).alias("pos"), F.lit("title").alias("kind"), none.alias("row"), none.alias("col"), F.col("title").alias("text"))


def write_back(blocks: DataFrame, jobs: DataFrame, key: str = "page_id") -> DataFrame:
    """Blocks with their translation in place of their text and, by row and column, of their table cells."""
    texts = jobs.filter("row IS NULL AND pos >= 0").select(key, "pos", "translated")
    inner = lambda order, value: F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    cells = jobs.filter("row IS NOT NULL").groupBy(key, "pos", "row").agg(inner("col", "translated").alias("cells"))
    tables = cells.groupBy(key, "pos").agg(F.coalesce(F.first(F.when(F.col("row") == 0, F.col("cells")), True), F.array().cast("array<string>")).alias("_header"), F.transform(F.array_sort(F.collect_list(F.when(F.col("row") > 0, F.struct("row", "cells")))), lambda x: x["cells"]).alias("_rows"))
    out = blocks.join(texts, [key, "pos"], "left").withColumn("text", F.coalesce("translated", "text")).drop("translated")
    if "tbl" not in blocks.columns:
        return out
    out = out.join(tables, [key, "pos"], "left")
    table = F.when(F.col("_rows").isNotNull(), F.struct(F.col("_header").alias("header"), F.col("_rows").alias("rows"), F.col("tbl.columns").alias("columns"))).otherwise(F.col("tbl"))
    return out.withColumn("tbl", table).drop("_header", "_rows")


def translate_text(text: Column, translate: Callable[[Column], Column], most: int = 3000) -> Column:
    """One text: protected pieces masked, chunks translated by a column over each, put together and restored, or left."""
    masked = T.protect(text)
    done = T.restore(F.array_join(F.transform(T.chunk_text(masked["masked"], most), translate), " "), masked["parts"])
    return F.when(F.trim(text) == "", text).otherwise(F.coalesce(done, text))


def translate_blocks(articles: DataFrame, translate: Callable[[Column], Column], *, most: int = 3000) -> DataFrame:
    """Articles with title, block texts and table cells translated in place, without a join."""
    one = lambda t: translate_text(t, translate, most)
    worded = lambda b: b["kind"].isin("paragraph", "heading", "caption", "quote", "list_item")
    cells = lambda a: F.transform(a, one)

    def block(b: Column) -> Column:
        table = F.when(b["tbl"].isNotNull(), F.struct(cells(b["tbl"]["header"]).alias("header"), F.transform(b["tbl"]["rows"], cells).alias("rows"), b["tbl"]["columns"].alias("columns")))
        return b.withField("text", F.when(worded(b), one(b["text"])).otherwise(b["text"])).withField("tbl", table)

    return articles.withColumns({"title": one(F.col("title")), "blocks": F.transform("blocks", block)})
