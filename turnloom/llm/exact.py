"""Exact dedup by deterministic block naming, with DataFrame functions only.

Every text is cut into blocks of a fixed number of bytes. Blocks are sorted and each distinct block
gets an integer name; then names of up to 16 adjacent blocks make a run, the runs are sorted and named
in turn, and so on until one name stands for the whole text. Names stand for whole values, never for
hashes of them, so two texts have the same last name (at the same level) only if they are identical.

Hashes only deal the work out: a block goes to the bucket of its hash, is sorted there, and is named
by bucket and rank. A value that makes up more than a thousandth of the rows would overfill its
bucket; there are at most a thousand hashes of such values, which are listed first, and their few
distinct values are named apart and joined back from a broadcast of that bounded list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import column, cut, with_rows

#: A value with more than one in so many rows is named apart.
HOT_SHARE = 1000
#: Values are dealt over so many buckets; a name is bucket << 44 plus the rank in it.
BUCKETS = 1 << 16
#: Names of 2 to this power adjacent values make a value of the next level. Every level is a few jobs, whose
#: plans and tasks the driver keeps, so levels are to be few.
RUN_BITS = 4


def name_values(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """df with ``name``, an integer that is equal where and only where the keys are equal.

    hot_rows: a value with more rows than this is named apart; it should be rows / HOT_SHARE or more,
    which bounds the list of such values. df is read up to three times.
    """
    key: Column = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    dealt = df.withColumn("_h", F.xxhash64(*keys))
    hot = [r[0] for r in dealt.groupBy("_h").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select("_h").collect()]
    bucket = F.pmod(F.col("_h"), F.lit(BUCKETS))
    cold = dealt.filter(~F.col("_h").isin(hot)) if hot else dealt
    cold = cold.withColumn("_b", bucket)
    ranked = F.dense_rank().over(Window.partitionBy("_b").orderBy(*keys))
    named = cold.withColumn("name", F.shiftleft(F.col("_b"), 44) + ranked).drop("_b", "_h", *keys)
    if not hot:
        return named
    rows = dealt.filter(F.col("_h").isin(hot)).drop("_h").withColumn("_k", key)
    few = rows.select("_k").distinct()
    few = few.withColumn("name", -F.row_number().over(Window.orderBy("_k")).cast("long"))
    # a bounded list: at most HOT_SHARE hashes, each of as good as always one value
    apart = rows.join(F.broadcast(few), "_k").drop("_k", *keys)
    return named.unionByName(apart)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, row_col: str | None = None) -> DataFrame:
    """One row per row of df: ``doc_id, keep_id, group_size, kept, text_sha256``, and ``row``, the
    row's number: row_col where df has one.

    Texts are equal when identical without any change; null counts as the empty text. Of equal texts
    the row with the largest id stays (null ids count as smallest); where that id itself repeats, one
    of its rows stays. Rows with equal texts get that row's id as keep_id. Other columns of df are
    ignored, whatever their names. An empty table gives an empty result.
    """
    body = F.coalesce(column(df, text_col, "string"), F.lit("")).cast("binary")
    taken = [column(df, id_col, "bigint").alias("doc_id"), body.alias("body")]
    rows = with_rows(df, "row", taken) if row_col is None else df.select(*taken, column(df, row_col, "bigint").alias("row"))
    width = F.greatest(F.ceil(F.octet_length("body") / F.lit(block_bytes)), F.lit(1)).cast("int")
    total, widest = rows.agg(F.sum(width), F.max(width)).first()
    hot_rows = max(1000, (total or 0) // HOT_SHARE)
    block = lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes))
    blocks = rows.select("row", "doc_id", F.unhex(F.sha2("body", 256)).alias("sha"), width.alias("width"), F.posexplode(F.transform(F.sequence(F.lit(0), width - 1), block)).alias("pos", "block"))
    first = F.col("pos") == 0
    blocks = blocks.select("row", "pos", "width", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha"), "block")
    level, done, last, widest = 0, [], (1 << RUN_BITS) - 1, widest or 1
    named = cut(name_values(blocks, ["block"], hot_rows))
    while True:
        done.append(named.filter("width = 1").select(F.lit(level).alias("level"), "name", "row", "doc_id", "sha"))
        if widest <= 1:
            break
        level += 1
        widest = widest + last >> RUN_BITS
        run = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
        runs = named.filter("width > 1").groupBy("row", F.shiftright("pos", RUN_BITS).alias("pos")).agg(F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.first("width").alias("width"), run.alias("run"))
        runs = cut(runs.withColumn("width", F.shiftright(F.col("width") + last, RUN_BITS)))
        named = cut(name_values(runs, ["run"], hot_rows))
    texts = done[0]
    for more in done[1:]:
        texts = texts.unionByName(more)
    # one table, not all levels' in each of the plans that follow, which the driver goes through stage by stage
    texts = cut(texts) if level else texts
    groups = texts.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))
    # groups above the limit are at most HOT_SHARE, so their rows stay where they are
    hot = F.broadcast(groups.filter(F.col("group_size") > hot_rows))
    large = texts.join(hot, ["level", "name"])
    rest = texts.join(hot.select("level", "name"), ["level", "name"], "left_anti").join(groups.filter(F.col("group_size") <= hot_rows), ["level", "name"])
    return large.unionByName(rest).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "row"
    )


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
