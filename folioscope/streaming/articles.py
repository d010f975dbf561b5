"""Extraction over a stream of pages: stateless per page, so the batch operator applies as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators.extract import extract_articles


def stream_articles(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    return extract_articles(spark.readStream.schema(schema).parquet(path))


def write_stream(articles: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return articles.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
