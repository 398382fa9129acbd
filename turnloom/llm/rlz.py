"""Substring dedup in words by relative Lempel-Ziv parsing.

The reference is every document, in blocks: around each sampled position (see ``sampling``) a block of up
to 84 words, all that any run of 50 words sampled there can hold. The index has each distinct block once,
with its owner: the place where the earliest document has it.

Every document is then factored against the index. Its blocks are looked up, and the parse goes from left
to right: a factor begins at a block that an earlier document owns and goes on as long as the blocks that
follow continue the same copy, at the same distance in the same owner; else the next factor begins. Any
factor is 50 words long or longer, so it is a duplicate span as a whole.

Factors end in blocks, and copies end in words. At factor boundaries, which are the blocks that the index
has only with other surroundings, the runs of 50 words are looked up one by one in an index of such runs;
those that an earlier document has extend the spans, also where no whole block repeats.

Lookups are by 128 bits. An index row is made of all equal blocks of a task first. Blocks whose gram is
very common are dealt out by their content, and those that are decided within a task at random, so no
gram and no block fills one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import cut, slices
from turnloom.llm.sampling import GRAM, LENGTH, SIDE, Units, apart, candidates, covered, hot_grams, later, numbered, pair, wanted

#: Words of a block left of its gram, and from the gram on.
BEFORE, AFTER = LENGTH - GRAM, LENGTH

BLOCKS = "gram long, key1 long, key2 long, hot boolean, ord long, row long, place long, begin long, end long, near int"
FACTORS = "row long, factors array<struct<begin:long,end:long,owner:long,at:long>>"
SCHEMA = "row long, doc_id long, n_words long, n_removed long, n_factors long, kept_sha256 string"


def _blocks(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            u = Units.of_words(texts)
            places, text, grams, near = wanted(part, u)
            begin, end = np.maximum(places - BEFORE, u.first[text]), np.minimum(places + AFTER, (u.first + u.counts)[text])
            extent = ((places - begin) << 8 | end - places).astype(np.uint64)
            keys = [pair(pair(u.at(places - BEFORE, LENGTH, k), u.at(places, AFTER, k), k), extent, k) for k in (0, 1)]
            take = pa.array(text)
            yield pa.RecordBatch.from_pydict({
                "gram": pa.array(grams.view(np.int64)), "key1": pa.array(keys[0].view(np.int64)), "key2": pa.array(keys[1].view(np.int64)), "hot": pa.array(np.isin(grams, hot)),
                "ord": part.column("ord").take(take), "row": part.column("row").take(take), "place": pa.array(places - u.first[text]), "begin": pa.array(begin - u.first[text]), "end": pa.array(end - u.first[text]), "near": pa.array(near.astype(np.int32)),
            })

    return run


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors of each row from its blocks with owners, left to right."""
    for batch in batches:
        found = []
        for blocks in batch.column("blocks").to_pylist():
            factors: list[dict] = []
            for b in sorted(blocks, key=lambda b: b["place"]):
                at = b["owner_place"] - b["place"] + b["begin"]
                last = factors[-1] if factors else None
                if last and last["owner"] == b["owner"] and at - last["at"] == b["begin"] - last["begin"] and b["begin"] <= last["end"]:
                    last["end"] = max(last["end"], b["end"])
                elif not last or b["end"] > last["end"]:
                    factors.append({"begin": b["begin"], "end": b["end"], "owner": b["owner"], "at": at})
            found.append(factors)
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("begin", "end", "owner", "at")]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, kind)], names=["row", "factors"])


def _boundary_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        u = Units.of_words(texts)
        lists = part.column("bounds")
        counts = lists.value_lengths().fill_null(0).to_numpy()
        listed = lists.flatten()
        places, near = listed.field("place").to_numpy() + np.repeat(u.first, counts), listed.field("near").to_numpy()
        starts, least = u.minimizers()
        if not len(places) or not len(starts):
            continue
        sort = np.argsort(places)
        at = sort[np.minimum(np.searchsorted(places, least, sorter=sort), len(places) - 1)]
        near, left = near[at], least - starts
        # a run that holds a whole side of its gram repeats only where that side does
        starts = starts[(places[at] == least) & ((left < SIDE) | (near & 1 > 0)) & ((BEFORE - left < SIDE) | (near & 2 > 0))]
        text = u.text_of(starts)
        key1, key2 = u.at(starts, LENGTH), u.at(starts, LENGTH, 1)
        row, order = (part.column(c).to_numpy()[text] for c in ("row", "ord"))
        found = later([key1, key2], order)
        key1, key2 = np.where(found, apart(row, starts), key1), np.where(found, 0, key2)
        yield pa.RecordBatch.from_pydict({"key1": pa.array(key1.view(np.int64)), "key2": pa.array(key2.view(np.int64)), "ord": pa.array(order), "row": pa.array(row), "begin": pa.array(starts - u.first[text]), "found": pa.array(found)})


def looked_up(blocks: DataFrame) -> DataFrame:
    """blocks with the index's answer: ``owner`` (ord, row, place of the earliest) and ``varied``, whether
    the index has the gram in other surroundings too.

    The index is aggregated within tasks before it is dealt out. What a key's rows are joined with is one
    row; keys of very many rows are a bounded list that is broadcast to them instead.
    """
    where = F.struct("ord", "row", "place")
    index = cut(blocks.groupBy("gram", "key1", "key2", "hot").agg(F.min(where).alias("owner"), F.count("*").alias("n")))
    total = index.agg(F.sum("n")).first()[0] or 0
    limit = max(10_000, total // 1000)
    grams = index.filter("not hot").groupBy("gram").agg((F.min("key1") != F.max("key1")).alias("varied"))
    # a block without a copy matters only where its gram has other blocks; hot grams have, and are not joined
    known = index.filter("n > 1 and not hot").join(grams, "gram").unionByName(index.filter("n = 1 and not hot").join(grams.filter("varied"), "gram"))
    known = known.unionByName(index.filter("hot").withColumn("varied", F.lit(True)))
    known = cut(known.select("key1", "key2", "owner", "n", "varied"))
    common = F.broadcast(known.filter(F.col("n") > limit).drop("n"))  # 1,000 at most
    many = blocks.join(common, ["key1", "key2"])
    rest = blocks.join(common.select("key1", "key2"), ["key1", "key2"], "left_anti").join(known.filter(F.col("n") <= limit).drop("n"), ["key1", "key2"])
    return many.unionByName(rest)


def parsed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Factors of rows (row, doc_id, ord, text) as ``row, factors``, and the runs that factor boundaries
    add as ``row, begin, end``."""
    lists = candidates(rows, Units.of_words)
    blocks = cut(rows.select("row", "ord", "text").join(lists, "row").mapInArrow(_blocks(hot_grams(lists)), BLOCKS))
    found = cut(looked_up(blocks).select("row", "place", "begin", "end", "near", "varied", "ord", "owner").withColumn("copied", F.col("ord") > F.col("owner.ord")).filter("copied or varied"))
    copies = found.filter("copied").groupBy("row").agg(F.collect_list(F.struct("place", "begin", "end", F.col("owner.row").alias("owner"), F.col("owner.place").alias("owner_place"))).alias("blocks"))
    factors = copies.mapInArrow(_parse, FACTORS)
    bounds = found.filter("not copied").groupBy("row").agg(F.collect_list(F.struct("place", "near")).alias("bounds"))
    runs = rows.select("row", "ord", "text").join(bounds, "row").mapInArrow(_boundary_runs, "key1 long, key2 long, ord long, row long, begin long, found boolean")
    runs = runs.withColumn("low", F.min("ord").over(Window.partitionBy("key1", "key2"))).filter("found or ord > low")
    return factors, cut(runs.select("row", "begin", (F.col("begin") + LENGTH).alias("end")))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its spans."""
    for part, texts in slices(batches):
        texts.words()
        first = texts.first
        gone = covered(part.column("spans"), first, int(first[-1])) if "spans" in part.schema.names else np.zeros(int(first[-1]), bool)
        factors = part.column("n_factors") if "n_factors" in part.schema.names else pa.array(np.zeros(len(texts), np.int64))
        counts, digests = [], []
        for i in range(len(texts)):
            words, drop = texts.text(i).split(), gone[first[i] : first[i + 1]]
            counts.append(int(drop.sum()))
            digests.append(hashlib.sha256(b" ".join([w for w, d in zip(words, drop.tolist()) if not d] if counts[-1] else words)).hexdigest())
        yield pa.RecordBatch.from_pydict({"row": part.column("row"), "doc_id": part.column("doc_id"), "n_words": pa.array(np.diff(first).astype(np.int64)), "n_removed": pa.array(counts, pa.int64()), "n_factors": factors, "kept_sha256": digests})


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: ``doc_id, n_words, n_removed, n_factors, kept_sha256`` (of the kept words
    joined by one space). n_factors counts the factors that are copied from an earlier document.

    A word is removed if it is covered by 50 consecutive words that also start in a document with a
    smaller id; runs are judged on the input. Null and empty texts have no words. Null ids count as
    larger than any, rows with equal ids do not remove each other's words. Texts may be of any length.
    Other columns are ignored, whatever their names. An empty table gives an empty result. df is read
    several times, and is written once first if it is no Parquet table.
    """
    rows = numbered(df, id_col, text_col)
    factors, runs = parsed(rows)
    single = runs.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    short = F.transform("factors", lambda f: F.struct(f["begin"].alias("begin"), f["end"].alias("end")))
    spans = factors.join(single, "row", "full").select("row", F.coalesce(F.size("factors"), F.lit(0)).cast("long").alias("n_factors"), F.concat(F.coalesce(short, none), F.coalesce("runs", none)).alias("spans"))
    touched = cut(rows.select("row", "doc_id", "text").join(spans, "row").mapInArrow(_digest, SCHEMA))
    others = rows.select("row", "doc_id", "text").mapInArrow(_digest, SCHEMA)  # digests cross the shuffle, not texts
    return touched.unionByName(others.join(touched.select("row"), "row", "left_anti")).drop("row")


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM words WHERE len(w) >= 50),
keyed AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k FROM runs),
low AS (SELECT k, min(doc_id) AS m FROM keyed GROUP BY k HAVING min(doc_id) < max(doc_id)),
again AS (SELECT doc_id, p FROM keyed JOIN low USING (k) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM again),
lists AS (SELECT doc_id, list(i) AS g, count(*) AS n FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, i, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words)),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN lists l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
