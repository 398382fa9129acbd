"""Which share links are taken: parse, route by host, admit or quarantine, and limit rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import rules

BAD_URL = "Not an absolute URL."
SHORT_LINK = "Short links are not resolved here: give the address that this one leads to."
UNSUPPORTED = "No public share link of a known platform."
BLOCKED = "A bot check stands in place of the page."


def host(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def provider_of_host(name: Column) -> Column:
    found = F.lit("unknown")
    for known, provider in rules.HOSTS.items():
        found = F.when(name == known, provider).otherwise(found)
    return found


def admit(links: DataFrame) -> DataFrame:
    """links with ``provider, status, error``: status 200 and no error for links that are taken, else 400."""
    url = F.col("url")
    name, path, scheme = host(url), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    provider = F.when(name.isNull(), "unknown").otherwise(provider_of_host(name))
    share = F.when(provider == "qwen", path.rlike("(?i)^/s/[A-Za-z0-9_-]+/?$")).otherwise(path.rlike("(?i)^/share/[A-Za-z0-9_-]+/?$"))
    error = (
        F.when(scheme.isNull() | name.isNull(), BAD_URL)
        .when((name == "g.co") & F.lower(path).contains("/gemini/share/"), SHORT_LINK)
        .when((scheme != "https") | (provider == "unknown") | ~share, UNSUPPORTED)
    )
    return links.withColumns({"provider": provider, "status": F.when(error.isNull(), 200).otherwise(400), "error": error})


def accepted(admitted: DataFrame) -> DataFrame:
    return admitted.filter("status = 200").drop("status", "error")


def rejected(admitted: DataFrame) -> DataFrame:
    """The quarantine table: url, code, message."""
    return admitted.filter("status <> 200").select("url", F.col("status").alias("code"), F.col("error").alias("message"))


def guard_blocked(pages: DataFrame) -> DataFrame:
    """pages with ``error`` where the page is a bot check instead of a conversation."""
    hit = F.lit(False)
    for mark in rules.BLOCKED_MARKS:
        hit = hit | F.coalesce(F.col("html"), F.lit("")).contains(mark)
    return pages.withColumn("error", F.when(hit, BLOCKED).cast("string"))


def collected_or_whole(collected: Column | str, whole: Column | str, provider: Column | str) -> Column:
    """What a collector gathered, where it holds a turn, else the page as it is."""
    collected = F.coalesce(F.col(collected) if isinstance(collected, str) else collected, F.lit(""))
    provider = F.col(provider) if isinstance(provider, str) else provider
    good = F.when(provider == "chatgpt", collected.rlike("(?i)data-message-author-role|conversation-turn-|data-turn=")).when(provider == "qwen", collected.rlike("(?i)share-layout-messages|qwen-chat-message")).otherwise(False)
    return F.when(good, collected).otherwise(F.col(whole) if isinstance(whole, str) else whole)


def rate_limit(requests: DataFrame, client: str, ts: str, order: str, limit: int = 20, window: str = "15 minutes") -> DataFrame:
    """requests with ``admitted``: the first ``limit`` of each client in each epoch-aligned window."""
    slot = F.window(F.col(ts).cast("timestamp"), window)["start"]
    number = F.row_number().over(Window.partitionBy(client, slot).orderBy(ts, order))
    return requests.withColumn("admitted", number <= limit)
