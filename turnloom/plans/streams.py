"""Streams over the events table, run until all of it is read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sources import documents, tables
from turnloom.streaming import captures, turns


_STORE = "spark.sql.streaming.stateStore.providerClass"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a stream reads folders; the pattern matches the table whether it is one file or a folder of them
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream gives for all that is there now, written to the shared folder and read again."""
    where = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="turnloom-")
    path = f"{where.rstrip('/')}/stream-{uuid.uuid4().hex}"
    running = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def first_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type."""
    events = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    return drained(spark, turns.first_captures(events, ["user_id", "event_type"], "ts", ["ts", "event_id"], keep_minutes=365 * 1440)).select("user_id", "event_type", "event_id")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per user and 15 minutes."""
    found = drained(spark, turns.rate_limit(_events(spark, sf_dir), "user_id", "ts", "event_id", limit=1))
    return found.select(F.col("id").alias("event_id"), "admitted")


def _folder(spark: SparkSession, kind: str) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="turnloom-")
    return f"{where.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def in_parts(spark: SparkSession, rows: DataFrame, by: list[str], made: Callable[[DataFrame], DataFrame], schema: str, parts: int) -> DataFrame:
    """What a stateful stream makes of rows (with a time ``ts``) that come in so many parts, dealt by hash and
    so in no order; last a row comes that says that time has gone on. The stream stops after each part and
    goes on from its state."""
    path = _folder(spark, "parts")
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(parts)))
    dealt.write.partitionBy("_part").parquet(f"{path}/rows")
    written = spark.read.parquet(f"{path}/rows")
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, captures.STORE)
    try:
        for part in range(parts + 1):
            end = spark.range(1).select(*(F.timestamp_seconds(F.lit(10**9)).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema))
            (written.filter(F.col("_part") == part).drop("_part") if part < parts else end).write.mode("append").parquet(f"{path}/in")
            stream = made(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
            running = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
            running.awaitTermination()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    return spark.read.schema(schema).parquet(f"{path}/out")


def captured_bodies(spark: SparkSession, polls: DataFrame, parts: int = 5) -> DataFrame:
    """``page_id, body`` of turns (page_id, key, pos, html, ts) that come in so many parts, in no order."""
    return in_parts(spark, polls, ["page_id", "pos"], captures.page_bodies, captures.BODIES, parts)


def scroll_stops(spark: SparkSession, polls: DataFrame, parts: int = 3) -> DataFrame:
    """Where captures stop, by polls (page_id, step, top, bottom, keys, ts) that come in so many parts, in no order."""
    return in_parts(spark, polls, ["page_id", "step"], captures.scroll_stops, captures.STOPS, parts)


def stored_batches(spark: SparkSession, pages: DataFrame, made: Callable[[DataFrame], DataFrame], parts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Good and quarantined conversations of pages that come as a stream, in so many micro-batches (fewer of a few pages)."""
    path = _folder(spark, "batches")
    # a batch has many files, and so many tasks: one file a batch would have one task read it
    cores = spark.sparkContext.defaultParallelism
    pages.repartition(parts * cores, F.xxhash64("page_id")).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", cores).parquet(f"{path}/in")
    running = stream.writeStream.foreachBatch(tables.batch_writer(made, path)).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    running.awaitTermination()
    return tables.read_batches(spark, path)


def guide_files(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """A guide of every document, written as JSON arrays of a thousand, and read again in their order."""
    i = F.col("doc_id")
    name = lambda c: F.concat(F.lit("g"), c.cast("string"))
    guide = F.struct(name(i).alias("slug"), F.concat(F.lit('Guide "'), i.cast("string"), F.lit('" | S')).alias("title"), F.col("text").alias("intro"), (i % 2 == 0).alias("noindex"), F.array(name(i + 1)).alias("relatedSlugs"))
    files = documents.groupBy(F.floor(i / 1000).alias("part")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(i.alias("at"), guide.alias("guide")))), lambda g: g["guide"])).alias("value"))
    path = _folder(spark, "guides")
    # a folder per file, named so that folders sort as the guides in them
    files.select(F.lpad(F.col("part").cast("string"), 12, "0").alias("part"), "value").repartition("part").write.partitionBy("part").text(path)
    return tables.read_guides(spark, path).select("position", "slug", "title", "noindex", F.col("related_slugs")[0].alias("related"), F.md5("intro").alias("intro"))


def sitemap_files(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """A site map entry of every page, written as XML, and read again."""
    i = F.col("page_id")
    entries = pages.select(
        F.concat(F.lit("https://x.test/?p="), i.cast("string"), F.lit("&q="), (i % 7).cast("string")).alias("loc"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 400).cast("int")).alias("lastmod"),
        F.when(i % 3 != 0, "weekly").alias("changefreq"), ((i % 10) / 10).alias("priority"),
    )
    path = _folder(spark, "sitemap")
    entries.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)
    return tables.read_sitemap(spark, path)


def document_files(spark: SparkSession, rendered: DataFrame) -> DataFrame:
    """Rendered documents (page_id, document) as a file each, read again: ``page_id, html``."""
    documents.register(spark)
    path = _folder(spark, "documents")
    rendered.filter("document is not null").select(F.col("page_id").cast("string").alias("name"), "document").write.format(documents.NAME).mode("append").save(path)
    found = spark.read.format(documents.NAME).load(path)
    return found.select(F.regexp_extract("path", r"([^/]+)\.html$", 1).cast("long").alias("page_id"), "html")
