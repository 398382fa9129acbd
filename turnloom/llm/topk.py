"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights, one term per component. Queries and candidates are
packed into blocks of bounded size. A block of each meets in one task: the candidate block is read
as postings, term by term, and each query's weight times the postings is added to a dense array of
scores, so every candidate gets its exact score. Each query's k best of the block are then selected
by partition, and the few rows left of all blocks are merged by a window that keeps k per query.

The queries are a stated set against all rows, in blocks: no row is made for a pair that its block
does not select, and a task holds one block of each side whatever the size of the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import column, cut

#: Members of a block of candidates, of a block of queries, and queries that share a score array.
BLOCK, QUERY_BLOCK, TOGETHER = 4096, 4096, 64

PACKED = "part long, ids binary, kind string, width long, terms binary"
FOUND = "query_id long, vec_id long, score long"


def integer_rows(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, terms``: floor(scale * x) of every component x, x as double."""
    rows = df.select(column(df, id_col, "bigint").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter("vec_id is not null and v is not null").filter(~bad)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("terms"))


def _packer(size: int):
    """Packs the rows of a task into blocks of at most so many, in the order of their ids."""

    def block(ids: list[np.ndarray], flat: list[np.ndarray], lengths: list[np.ndarray], number: int) -> pa.RecordBatch:
        id_, value, length = np.concatenate(ids), np.concatenate(flat), np.concatenate(lengths)
        width = int(length.max()) if len(length) else 0
        terms = np.zeros((len(id_), width), np.int64)
        terms[np.arange(width) < length[:, None]] = value
        order = np.argsort(id_, kind="stable")
        reach = int(np.abs(value).max()) if len(value) else 0
        kind = next(k for k, top in (("int8", 127), ("int16", 32767), ("int32", 2**31 - 1), ("int64", 2**63)) if reach <= top)
        return pa.RecordBatch.from_pydict({
            "part": pa.array([number], pa.int64()), "ids": pa.array([id_[order].tobytes()], pa.binary()), "kind": [kind],
            "width": pa.array([width], pa.int64()), "terms": pa.array([terms[order].astype(kind).tobytes()], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = [], [], []
        count = number = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(size - count, batch.num_rows - at))
                lists = part.column("terms")
                held[0].append(part.column("vec_id").to_numpy())
                held[1].append(lists.flatten().to_numpy())
                held[2].append(lists.value_lengths().to_numpy())
                at, count = at + part.num_rows, count + part.num_rows
                if count == size:
                    yield block(*held, number)
                    held, count, number = ([], [], []), 0, number + 1
        if count:
            yield block(*held, number)

    return run


def _numbered(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of rows as ``<name>`` (0, 1, ...) and their contents."""
    packed = rows.mapInArrow(_packer(size), PACKED).withColumn("at", F.monotonically_increasing_id())
    packed = cut(packed.drop("part"))
    # one small row per block of thousands is numbered; the blocks stay where they are
    numbers = packed.select("at").withColumn(name, F.row_number().over(Window.orderBy("at")) - 1)
    fields = [c for c in packed.columns if c != "at"]
    return packed.join(numbers, "at").select(F.col(name).cast("long"), *(F.col(c).alias(f"{name}_{c}") for c in fields))


def _scores(query: np.ndarray, postings: np.ndarray, members: list[np.ndarray], kind: type) -> np.ndarray:
    """Scores of a few queries with all members of a block, term at a time."""
    scores = np.zeros((len(query), postings.shape[1]), kind)
    for term in range(min(query.shape[1], len(postings))):
        weights = query[:, term].astype(kind)
        asks = np.flatnonzero(weights)
        if not len(asks) or not len(members[term]):
            continue
        if 2 * len(members[term]) >= postings.shape[1]:  # nearly every member: zeros add nothing
            scores += weights[:, None] * postings[term]
        else:
            scores[asks[:, None], members[term]] += weights[asks, None] * postings[term][members[term]]
    return scores


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                read = lambda name: (np.frombuffer(row[f"{name}_ids"], np.int64), np.frombuffer(row[f"{name}_terms"], row[f"{name}_kind"]).reshape(-1, max(1, row[f"{name}_width"])) if row[f"{name}_width"] else np.zeros((len(row[f"{name}_ids"]) // 8, 0), np.int8))  # noqa: E731, B023
                asked, query = read("query")
                ids, terms = read("other")
                reach = int(np.abs(query.astype(np.int64)).max(initial=0)) * int(np.abs(terms.astype(np.int64)).max(initial=0)) * max(1, terms.shape[1])
                kind = np.int32 if reach < 2**31 else np.int64
                postings = np.ascontiguousarray(terms.T).astype(kind)
                members = [np.flatnonzero(p) for p in postings]
                n = len(ids)
                for at in range(0, len(asked), TOGETHER):
                    few = asked[at : at + TOGETHER]
                    scores = _scores(query[at : at + TOGETHER], postings, members, kind).astype(np.int64)
                    own = few[:, None] == ids
                    take = ~own
                    if n > k:
                        shown = np.where(own, np.iinfo(np.int64).min, scores)
                        last = np.partition(shown, n - k, axis=1)[:, n - k, None]
                        # of those that tie at the k-th score the first are taken: a block is in order of ids
                        above, tied = shown > last, (shown == last) & ~own
                        take = above | (tied & (np.cumsum(tied, 1) <= k - above.sum(1, keepdims=True)))
                    at_query, at_other = np.nonzero(take)
                    yield pa.RecordBatch.from_pydict({"query_id": few[at_query], "vec_id": ids[at_other], "score": scores[at_query, at_other]})

    return run


def exact_top_k(df: DataFrame, k: int = 20, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """For every query row its k highest integer inner products: ``query_id, rank, vec_id, score``.

    is_query: a condition on ``vec_id``; by default ids divisible by 20. Candidates are all rows with
    another id than the query's; ties go to the smaller id. With fewer than k candidates all are
    returned. Vectors that are null or hold a null or non-finite component take no part, nor do rows
    without an id; of repeated ids every row is a candidate and, if asked, a query. Shorter vectors
    count as padded with zeros. Scores must fit in 64 bits. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = integer_rows(df, id_col, vector_col, scale)
    asked = rows.filter(F.col("vec_id") % 20 == 0 if is_query is None else is_query)
    # only the queries are dealt anew, into as many parts as they fill blocks
    asked = asked.repartition(max(1, -(-asked.count() // QUERY_BLOCK)))
    queries, others = _numbered(asked, QUERY_BLOCK, "query"), _numbered(rows, BLOCK, "other")
    n_queries, n_others = queries.count(), others.count()
    if not n_queries or not n_others:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    left = queries.select("*", each(n_others, "other"))
    right = others.select("*", each(n_queries, "query"))
    tiles = left.join(right.repartition(min(n_queries * n_others, 4000), "query", "other"), ["query", "other"])
    found = tiles.drop("query", "other").mapInArrow(_searcher(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS t FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.t, c.t)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
