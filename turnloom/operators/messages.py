"""Relational operators on messages: dedup, unions with gates, picks, order, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in order."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", number).filter("_n = 1").drop("_n")


def dedupe_messages(rows: DataFrame, scope: str = "conv_id", order: str = "pos", normalize: bool = True) -> DataFrame:
    """Of equal texts of one role in a conversation the first; messages without text go."""
    keyed = rows.withColumn("_key", text.dedupe_key("text", normalize)).filter("_key <> ''")
    return first_wins(keyed, [scope, "role", "_key"], [order]).drop("_key")


def _whole(scope: str) -> Column:
    own = Window.partitionBy(scope)
    return (F.count("*").over(own) >= 2) & F.bool_or(F.col("role") == "user").over(own) & F.bool_or(F.col("role") == "assistant").over(own)


def merge_sources(primary: DataFrame, fallback: DataFrame, scope: str = "conv_id", order: str = "pos", normalize: bool = True) -> DataFrame:
    """Per conversation the primary rows if they are a whole conversation (two rows or more, both roles),
    else primary and then fallback rows, without repeats."""
    complete = primary.withColumn("_whole", _whole(scope))
    ends = complete.filter("_whole").select(scope).distinct()
    parts = complete.filter("not _whole").drop("_whole").withColumn("_at", F.lit(0)).unionByName(fallback.join(ends, scope, "left_anti").withColumn("_at", F.lit(1)))
    keyed = parts.withColumn("_key", text.dedupe_key("text", normalize)).filter("_key <> ''")
    merged = first_wins(keyed, [scope, "role", "_key"], ["_at", order]).drop("_key")
    return complete.filter("_whole").drop("_whole").withColumn("_at", F.lit(0)).unionByName(merged).withColumnRenamed("_at", "source")


def prefer(primary: DataFrame, fallback: DataFrame, scope: str = "conv_id") -> DataFrame:
    """All primary rows, and fallback rows of conversations that have none."""
    return primary.unionByName(fallback.join(primary.select(scope).distinct(), scope, "left_anti"))


def widen(narrow: DataFrame, wide: DataFrame, scope: str = "conv_id", least: int = 2) -> DataFrame:
    """narrow, and wide's rows too for scopes in which narrow has fewer than ``least``."""
    enough = narrow.groupBy(scope).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(scope)
    return narrow.withColumn("stage", F.lit(1)).unionByName(wide.join(enough, scope, "left_anti").withColumn("stage", F.lit(2)))


def best_longest(rows: DataFrame, scope: str, value: str, order: str) -> DataFrame:
    """Per scope the longest text that is not blank; the first in order of equals."""
    number = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc(F.length(text.collapse(value))), order))
    return rows.filter(~text.blank(value)).withColumn("_n", number).filter("_n = 1").drop("_n")


def best_shortest(rows: DataFrame, scope: str, value: str, order: str, whole: Column, share: float = 0.55) -> DataFrame:
    """Per scope the shortest text that still has a share of the whole's length; first of equals."""
    size = F.length(text.collapse(value))
    fits = rows.filter((size >= 1) & (size >= F.floor(whole * share)))
    number = F.row_number().over(Window.partitionBy(scope).orderBy(size, order))
    return fits.withColumn("_n", number).filter("_n = 1").drop("_n")


def near_duplicate_pairs(rows: DataFrame, scope: list[str], ident: str, key: str, least: int = 40, gram: int = 24) -> DataFrame:
    """Pairs (a, b) of unique ids within a scope whose keys are longer than ``least`` and of which b's holds a's.

    A key that is held is a run of the other, so both have the smallest hash among the first grams of the
    held one: rows meet on that, not all with all of the scope. Of the other's grams only those matter that
    are smallest within some such window, about one in nine.
    """
    long = rows.filter(F.length(key) > least)
    octets, window = F.col(key).cast("binary"), least - gram + 1  # any place in bytes is found at once, unlike in characters
    hashes = lambda o, n: F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.substring(o, i, F.lit(gram))))
    shifted = lambda m, n: text.let(m, lambda m: F.zip_with(m, F.slice(m, n + 1, F.size(m)), lambda one, two: F.least(one, two)))

    def lows(h: Column) -> Column:
        """The smallest of each window, from those of two shorter ones: a slice at each place would read the whole list there."""
        wide = 1
        while wide < window:
            step = min(wide, window - wide)
            h, wide = shifted(h, step), wide + step
        return h

    held = long.select(*scope, F.col(ident).alias("a"), F.array_min(text.let(octets, lambda o: hashes(o, F.lit(window)))).alias("_run"))
    smallest = text.let(text.let(octets, lambda o: hashes(o, F.greatest(F.length(o) - gram + 1, F.lit(1)))), lambda h: text.let(lows(h), lambda m: F.array_distinct(F.slice(m, 1, F.greatest(F.size(m) - window + 1, F.lit(1))))))
    # no list is empty; plain explode has a test of its size pushed down, with all of the work in it
    holder = long.select(*scope, F.col(ident).alias("b"), F.explode_outer(smallest).alias("_run"))
    # ids meet first; keys, which are long, come in for the pairs that met
    met = held.join(holder, [*scope, "_run"]).filter(F.col("a") != F.col("b")).select(*scope, "a", "b").distinct()
    keys = long.select(F.col(ident), F.col(key))
    met = met.join(keys.toDF("a", "_ka"), "a").join(keys.toDF("b", "_kb"), "b")
    return met.filter(F.contains("_kb", F.col("_ka"))).select(*scope, "a", "b")


def assemble_conversations(rows: DataFrame, scope: str = "conv_id", order: str = "pos", title: Column | None = None) -> DataFrame:
    """Message rows (scope, order, role, text) to one row per conversation: ``n_messages, title,
    messages``, in order. Blank messages go; a conversation without any other has no row."""
    kept = rows.filter(~text.blank("text"))
    made = kept.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("pos"), F.col("role"), F.col("text")))).alias("messages"), *([F.max(title).alias("_title")] if title is not None else []))
    name = F.col("_title") if title is not None else F.lit("")
    return made.select(scope, F.size("messages").cast("long").alias("n_messages"), text.title_or_first_user(name, "messages").alias("title"), "messages")


def synthetic_documents(turns: DataFrame, scope: str, order: str, html: str, title: str, link: str) -> DataFrame:
    """Captured turns to one document per scope, in capture order."""
    made = turns.groupBy(scope).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, html))), lambda t: t[html]), "\n").alias("_body"), F.max(title).alias("_title"), F.max(link).alias("_link"))
    page = F.concat(F.lit("<!doctype html><html><head><title>"), text.escape_title("_title"), F.lit('</title><link rel="canonical" href="'), text.escape_attribute("_link"), F.lit('"></head><body><main>'), F.col("_body"), F.lit("</main></body></html>"))
    return made.select(scope, page.alias("html"))
