"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. A document's expected number of copies is its source's target
over its source's size. The whole part of that is certain and allocated first; the rest, a fraction
f, is an inclusion probability. Documents are then ranked by random odds over inclusion odds,
(u / (1 - u)) / (f / (1 - f)), and the lowest ranks are taken up to the words still missing.

Nothing is sorted per source as a whole: ranks are summed in a histogram of fixed size per source,
which shows all ranks that are surely taken and the one bin where the target falls; only that bin
is put in order. The document at the edge does not fit as a rule, so the same is done twice more
with the words then missing and the documents not larger than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import column, cut, row_of

BINS = 4096
#: Up to so many sources (a row each) are broadcast to the documents' tasks; more are joined by shuffle.
BROADCAST_SOURCES = 20_000
PASSES = 3
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """One row per source of (source, size): ``place, source, source_size, target``.

    Weights repeat over the sources by code point, null last. A target is at most ``most`` times its
    source's size; what is above is shared among the others by weight, until none is above. Sorted by
    that limit over weight, the sources at their limit come first, so one running sum finds the level.
    The windows here run over one row per source.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    each = each.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    whole = Window.partitionBy()
    each = each.withColumn("before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    each = each.withColumn("after", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    each = each.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - F.col("before")) / F.col("after"))
    each = each.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(whole))
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double"))
    return each.select("place", "source", "source_size", target.alias("target"))


def _edges(open_rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """For each source the bin in which its missing words end, and the words of the bins before."""
    bins = open_rows.groupBy("place", "bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("place").orderBy("bin"))
    bins = bins.withColumn("upto", upto).join(gaps, "place").filter(F.col("upto") > F.col("gap"))
    return bins.groupBy("place").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix", row_col: str | None = None) -> DataFrame:
    """One row per row of df: ``doc_id, source, size, source_size, target, copies, taken``, and ``row``,
    the row's number: row_col where df has one, else a monotonically increasing id.

    size: words of the text, null and empty texts have 0. copies: how often the mix takes the row (0
    to most), taken: copies * size. The words taken of a source never exceed its target, and miss it
    by less than the smallest documents left, as a rule. The same rows give the same mix, however they
    are laid out: chance comes from a digest of seed and id, ties are in order of id and size. Rows
    with equal ids each count by themselves. Null is a source of its own. Other columns are ignored.
    An empty table gives an empty result.
    """
    rows = df.select(column(df, id_col, "bigint").alias("doc_id"), column(df, source_col, "string").alias("source"), F.coalesce(F.regexp_count(column(df, text_col, "string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), row_of(df, row_col).alias("row"))
    rows = cut(rows)
    sources = cut(source_targets(rows, weights, share, most))
    few = sources.count() <= BROADCAST_SOURCES
    per_source = F.broadcast if few else (lambda small: small)
    full = F.col("target") / F.col("source_size")
    sources = sources.withColumn("certain", F.when(F.col("source_size") > 0, F.floor(full)).otherwise(0))
    sources = sources.withColumn("f", F.when(F.col("source_size") > 0, full - F.col("certain")).otherwise(0.0))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    keyed = rows.join(per_source(sources.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    keyed = keyed.withColumn("u", u).withColumn("q", F.when(F.col("f") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("f") / (1 - F.col("f")))))
    keyed = keyed.withColumn("bin", F.least(F.floor(F.col("q") / (1 + F.col("q")) * BINS), F.lit(BINS - 1))).withColumn("more", F.lit(False))
    keyed = cut(keyed.drop("u", "f"))
    for _ in range(PASSES):
        missing = F.first("target") - F.first("certain") * F.first("source_size") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))
        gaps = keyed.groupBy("place").agg(missing.alias("gap"))
        marked = keyed.join(per_source(gaps), "place")
        can = ~F.col("more") & (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & F.col("q").isNotNull()
        marked = marked.withColumn("can", can)
        edges = _edges(marked.filter("can"), gaps)
        marked = marked.join(per_source(edges), "place", "left")
        # written: what is read twice below has no joins, and the window does not take their partitions, with whole sources
        marked = cut(marked)
        at_edge = F.col("can") & F.col("edge").isNotNull() & (F.col("bin") == F.col("edge.bin"))
        inside = F.sum("size").over(Window.partitionBy("place").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
        edge = marked.filter(at_edge).withColumn("more", F.col("edge.before") + inside <= F.col("gap"))
        taken = F.col("more") | (F.col("can") & (F.col("edge").isNull() | (F.col("bin") < F.col("edge.bin"))))
        others = marked.filter(~at_edge).withColumn("more", taken)
        keyed = cut(edge.unionByName(others).select(*keyed.columns))
    copies = F.col("certain") + F.col("more").cast("int")
    return keyed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row")


_PASS = """
gap{p} AS (SELECT place, any_value(target) - any_value(certain) * any_value(source_size) - sum(CASE WHEN more THEN size ELSE 0 END) AS gap FROM take{o} GROUP BY place),
run{p} AS (SELECT t.* EXCLUDE (more), more, gap,
    (NOT more AND size > 0 AND size <= gap AND f > 0) AS can FROM take{o} t JOIN gap{p} USING (place)),
take{p} AS (SELECT * EXCLUDE (more, gap, can),
    more OR (can AND sum(CASE WHEN can THEN size ELSE 0 END) OVER (PARTITION BY place, can ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) <= gap) AS more FROM run{p})"""

SQL = (
    r"""
WITH rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
each0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
each1 AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) AS place FROM each0),
each2 AS (SELECT *, [3, 1, 2][((place - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM each1),
each3 AS (SELECT *, sum(cap) OVER (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING) - cap AS before,
    sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
    sum(source_size) OVER () AS total FROM each2),
each4 AS (SELECT *, (1.5::DOUBLE * total::DOUBLE - before::DOUBLE) / after::DOUBLE AS lev FROM each3),
each5 AS (SELECT *, max(CASE WHEN lev * weight <= cap THEN lev END) OVER () AS level FROM each4),
targets AS (SELECT place, source, source_size, least(cap::DOUBLE, level * weight) AS target FROM each5),
copies AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS certain FROM targets),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size - certain ELSE 0 END AS f FROM copies),
keyed AS (SELECT r.doc_id, r.size, p.*, (('0x' || md5('mix:' || r.doc_id)[1:12])::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
    FROM rows r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source),
take0 AS (SELECT *, CASE WHEN f > 0 THEN (u / (1 - u)) / (f / (1 - f)) END AS q, false AS more FROM keyed),"""
    + ",".join(_PASS.format(p=k + 1, o=k) for k in range(PASSES))
    + f"""
SELECT doc_id, size, source_size, target, ((certain + more::INT) * size)::BIGINT AS taken FROM take{PASSES}
"""
)
