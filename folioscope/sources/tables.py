"""Sources and sinks: page tables, filter lists by age, responses, and one output per article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T

MAX_LIST_AGE_DAYS = 7
#: Attempts at a page; only failures of the network are tried again, after WAIT_MS times the attempt's number.
ATTEMPTS, WAIT_MS = 3, 250


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_list(spark: SparkSession, urls: list[str]) -> DataFrame:
    if not urls:
        raise ValueError("at least one address is needed")
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")


def filter_lists(spark: SparkSession, path: str) -> DataFrame:
    """Text files of a folder with their age; ``fresh`` is under seven days."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"), "modificationTime")
    age = F.unix_seconds(F.current_timestamp()) - F.unix_seconds("modificationTime")
    return files.withColumn("age_s", age).withColumn("fresh", F.col("age_s") < MAX_LIST_AGE_DAYS * 86400)


def combined_lines(lists: DataFrame) -> DataFrame:
    """All lines of all lists."""
    return lists.select(F.explode(F.split("text", r"\r?\n")).alias("raw"))


def refreshed_lists(lists: DataFrame, fetched: DataFrame) -> DataFrame:
    """Lists (name, text, fresh) brought up to date: fresh ones as they are, others as fetched (name, text), or the old text if that failed."""
    new = fetched.select("name", F.col("text").alias("_new"))
    rows = lists.join(new, "name", "full_outer")
    held = F.coalesce("fresh", F.lit(False))
    origin = F.when(held, "cache").when(F.col("_new").isNotNull(), "network").when(F.col("text").isNotNull(), "stale").otherwise("missing")
    return rows.select("name", F.when(held, F.col("text")).otherwise(F.coalesce("_new", "text")).alias("text"), origin.alias("origin"))


def write_lists(lists: DataFrame, path: str) -> None:
    """Writes lists through to the cache, where filter_lists finds them with the time of writing."""
    lists.filter("text IS NOT NULL").select("name", "text").write.mode("overwrite").partitionBy("name").text(path)


def cache_age(lists: DataFrame) -> DataFrame:
    return lists.agg(F.max("age_s").alias("age_s"))


def accepted_pages(responses: DataFrame) -> DataFrame:
    """Responses (url, status, content_type, body) with their class and, where ok, their text."""
    rows = responses.withColumn("class", T.accepts(F.col("status"), F.col("content_type")))
    return rows.withColumn("html", F.when(F.col("class") == "ok", T.body_text(F.col("content_type"), F.col("body"))))


def settled_attempts(attempts: DataFrame, key: str = "url") -> DataFrame:
    """Attempts (key, attempt from 1, status, content_type) to the outcome of each address: its class, the attempts made and the time waited."""
    rows = attempts.filter(F.col("attempt") <= ATTEMPTS).withColumn("class", T.accepts(F.col("status"), F.col("content_type")))
    told = F.col("class") != "retry"
    out = rows.groupBy(key).agg(F.min(F.when(told, F.struct("attempt", "class"))).alias("_t"), F.max("attempt").alias("_n"))
    tries = F.coalesce(F.col("_t.attempt"), F.col("_n"))
    return out.select(key, F.coalesce("_t.class", F.lit("network")).alias("class"), tries.alias("attempts"), (F.lit(WAIT_MS) * (tries - 1) * tries / 2).cast("int").alias("waited_ms"))


def document_metadata(articles: DataFrame, *, author: str | None = None, lang: str | None = None, creator: str | None = None, made_s: Column | None = None) -> DataFrame:
    """What a document tells of itself: title, author (by default the host), its name and language, what made it (twice), and when (twice).

    made_s: seconds since 1970; without it, now.  An empty title or author, and no language, are null.
    """
    by = F.lit(author) if author else T.host(F.col("url"))
    date = T.pdf_date(F.unix_timestamp() if made_s is None else made_s)
    named = lambda c: F.nullif(c, F.lit(""))
    return articles.select(
        "page_id", named(F.col("title")).alias("title"), named(by).alias("author"), T.output_name(F.col("url")).alias("output_name"), named(F.lit(lang).cast("string")).alias("lang"),
        F.lit(creator).cast("string").alias("creator"), F.lit(creator).cast("string").alias("producer"), date.alias("created"), date.alias("modified"),
    )


def run_summary(articles: DataFrame) -> DataFrame:
    """Counts of a run; it fails as a whole only if nothing succeeded."""
    return articles.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed")).withColumn("exit_code", ((F.col("ok") == 0) & (F.col("failed") > 0)).cast("int"))


def write_articles(articles: DataFrame, path: str) -> None:
    """One row per page under its output name; failed pages are rows with a status."""
    articles.withColumn("output_name", T.output_name(F.col("url"))).write.mode("overwrite").parquet(path)
