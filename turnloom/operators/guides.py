"""Guide pages: lookup, related guides, lists, and structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guide(guides: DataFrame, slug: str, order: str = "position") -> DataFrame:
    """The guide of that slug, the first in order where several have it; no row if there is none."""
    return guides.filter(F.col("slug") == slug).orderBy(order).limit(1)


def short_title(title: Column | str) -> Column:
    """What stands before the first bar."""
    return F.trim(F.substring_index(title, "|", 1))


def related(guides: DataFrame, order: str = "position") -> DataFrame:
    """``slug, pos, related_slug, related_title``: each guide's related ones in its order, those that
    exist. Of guides with the same slug the first in order gives the title."""
    wanted = guides.select("slug", F.posexplode("related_slugs").alias("pos", "related_slug"))
    known = guides.groupBy(F.col("slug").alias("related_slug")).agg(F.min_by("title", order).alias("related_title"))
    return wanted.join(known, "related_slug").select("slug", F.col("pos").cast("long").alias("pos"), "related_slug", short_title("related_title").alias("related_title"))


def item_list(guides: DataFrame, base: str) -> Column:
    """A list entry of structured data for a guide with its position."""
    return F.to_json(F.struct(F.lit("ListItem").alias("@type"), F.col("position").alias("position"), F.concat(F.lit(base), F.col("slug")).alias("url"), short_title("title").alias("name")))


def faq_page(faqs: Column | str) -> Column:
    """Structured data of questions and answers."""
    entity = F.transform(faqs, lambda f: F.struct(F.lit("Question").alias("@type"), f["q"].alias("name"), F.struct(F.lit("Answer").alias("@type"), f["a"].alias("text")).alias("acceptedAnswer")))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), entity.alias("mainEntity")))


def breadcrumbs(base: str, site: str, heading: Column, slug: Column) -> Column:
    """Structured data of the path to a guide."""
    step = lambda n, name, item: F.struct(F.lit("ListItem").alias("@type"), F.lit(n).alias("position"), name.alias("name"), item.alias("item"))
    items = F.array(step(1, F.lit(site), F.lit(base)), step(2, F.lit("Tools"), F.lit(f"{base}tools")), step(3, heading, F.concat(F.lit(f"{base}tools/"), slug)))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), items.alias("itemListElement")))
