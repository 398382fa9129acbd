"""Readers and sinks: stored pages, site maps, guide files, conversations, errors, documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SITEMAP = "loc string, lastmod date, changefreq string, priority double"
GUIDES = (
    "slug string, title string, description string, keyword string, h1 string, intro string, useCase string, ctaText string, "
    "noindex boolean, sections array<struct<title:string,content:string>>, faqs array<struct<q:string,a:string>>, relatedSlugs array<string>"
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages: page_id, url, html."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "url").schema(SITEMAP).load(path)


def read_guides(spark: SparkSession, path: str) -> DataFrame:
    """Guide records of JSON arrays in their order, with ``position`` from 1: the order within a file, and
    of files by path. Only one small row per file is put in order on its own."""
    at = spark.read.schema(GUIDES).json(path, multiLine=True, recursiveFileLookup=True).withColumnRenamed("relatedSlugs", "related_slugs")
    # a file of one array is one split, so ids rise within it
    at = at.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()})
    files = at.groupBy("_file").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("_file", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return at.join(files, "_file").withColumn("position", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_file", "_at", "_first", "_before")


def write_conversations(conversations: DataFrame, path: str) -> None:
    """Conversations as JSON lines, one object each; those with an error are not written."""
    conversations.filter("error is null").drop("error").write.mode("overwrite").json(path)


def write_errors(conversations: DataFrame, path: str) -> None:
    """The quarantine: page_id, url, error."""
    conversations.filter("error is not null").select("page_id", "url", "error").write.mode("overwrite").parquet(path)


def write_documents(rendered: DataFrame, path: str) -> None:
    """Rendered documents by provider, in columns; a document is one value of the table."""
    rendered.filter("document is not null").select("page_id", "provider", "document").write.mode("overwrite").partitionBy("provider").parquet(path)


def batch_writer(made: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: conversations that ``made`` makes of a micro-batch, those without error as JSON
    lines under ``path/good``, page_id, url and error of the others under ``path/quarantine``. A batch has a
    folder of its own in each, so a batch that comes again replaces itself and changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        conversations = made(batch).persist()
        try:
            write_conversations(conversations, f"{path}/good/batch={batch_id}")
            write_errors(conversations, f"{path}/quarantine/batch={batch_id}")
        finally:
            conversations.unpersist()

    return write


def read_batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``batch_writer`` wrote under path: ``page_id, messages`` of good ones, and the quarantine."""
    good = spark.read.schema("page_id long, messages array<struct<role:string,text:string>>, batch long").json(f"{path}/good")
    return good.drop("batch"), spark.read.schema("page_id long, url string, error string, batch long").parquet(f"{path}/quarantine").drop("batch")
