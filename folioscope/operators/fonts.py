"""Which fonts have which characters: coverage as ranges of code points, for several fonts at once.

A font is rows (font, lo, hi) of code points.  Ranges are cut at buckets of 256 code points,
so characters meet them by an equi-join; only distinct characters are joined, of which there
are at most as many as code points, and texts look their own up afterwards.

Defined cases: null texts have no characters; overlapping ranges of a font count once; white
space, control and invisible characters need no font; a font that is not in the table has
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.relational import needs_glyph

BUCKET_BITS = 8


def code_point(ch: Column) -> Column:
    return F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("int")


def characters(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ch) of each row's distinct characters that are drawn."""
    return rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("(?s)."), F.lit(0)))).alias("ch")).filter(needs_glyph(F.col("ch")))


def fonts_of(chars: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ch, fonts) of the distinct characters that any font has: the sorted names of those that do."""
    points = chars.select("ch").distinct().withColumn("cp", code_point(F.col("ch"))).withColumn("bucket", F.shiftright("cp", BUCKET_BITS))
    cut = ranges.filter("lo <= hi").select("font", "lo", "hi", F.explode(F.sequence(F.shiftright(F.col("lo").cast("int"), BUCKET_BITS), F.shiftright(F.col("hi").cast("int"), BUCKET_BITS))).alias("bucket"))
    return points.join(cut, "bucket").filter("cp BETWEEN lo AND hi").groupBy("ch").agg(F.array_sort(F.collect_set("font")).alias("fonts"))


def font_plan(rows: DataFrame, key: str, ranges: DataFrame, *, main: str, fallback: str, text: str = "text") -> DataFrame:
    """Per key with drawn characters that the main font lacks: those the fallback has (falls) and those that neither has (missing), sorted."""
    chars = characters(rows, key, text)
    known = fonts_of(chars, ranges)
    has = lambda font: F.coalesce(F.array_contains("fonts", F.lit(font)), F.lit(False))
    lacking = chars.distinct().join(known, "ch", "left").filter(~has(main)).withColumn("falls", has(fallback))
    own = lambda test: F.array_sort(F.array_compact(F.collect_list(F.when(test, F.col("ch")))))
    return lacking.groupBy(key).agg(own(F.col("falls")).alias("falls"), own(~F.col("falls")).alias("missing"))


def text_runs(rows: DataFrame, key: str, ranges: DataFrame, *, main: str, fallback: str, text: str = "text") -> DataFrame:
    """(key, run, needs_fallback, start, n_chars): maximal runs of each text for one font; key must tell rows apart.

    A row's own characters make the pattern that cuts it, so only runs are put in order.
    """
    plan = font_plan(rows, key, ranges, main=main, fallback=fallback, text=text)
    wanted = F.array_join(F.transform("falls", lambda c: F.concat(F.lit(r"\x{"), F.hex(code_point(c)), F.lit("}"))), "")
    told = rows.select(key, F.col(text).alias("_t")).join(plan.filter("size(falls) > 0").select(key, wanted.alias("_c")), key, "left")
    pieces = F.when(F.col("_c").isNull(), F.filter(F.array("_t"), lambda x: x != "")).otherwise(F.regexp_extract_all("_t", F.concat(F.lit("(?s)["), "_c", F.lit("]++|[^"), "_c", F.lit("]++")), F.lit(0)))
    runs = told.select(key, "_c", F.posexplode(pieces).alias("at", "_r"))
    w = Window.partitionBy(key).orderBy("at")
    start = F.coalesce(F.sum(F.length("_r")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    falls = F.coalesce(F.regexp_like("_r", F.concat(F.lit("^["), "_c", F.lit("]"))), F.lit(False))
    return runs.select(key, (F.col("at") + 1).alias("run"), falls.alias("needs_fallback"), start.cast("int").alias("start"), F.length("_r").alias("n_chars"))
