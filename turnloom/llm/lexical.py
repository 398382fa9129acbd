"""Ranked lexical search over document shards of compressed postings with integer impacts.

A task packs its documents into shards of bounded size. A shard has, for every term that a query asks
for, the list of its documents and how often each has it, as flat arrays with one offset per term. Counts
over all shards (documents, their terms, documents per term) then give each term's weight, and a shard's
postings turn into integer impacts once, before any query is scored.

Queries are scored term at a time: a term's impacts are added to a dense array with a place per document
of the shard. The k best are selected by partition; of those that tie at the edge the smallest ids stay.
A task keeps k per query over all its shards, and those of all tasks are merged by windows, in two steps.

Queries are a stated set against all rows. They are taken in blocks of bounded vocabulary; only a block's
terms are broadcast, and each block is a pass over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import Texts, column, cut, slices

#: Bytes that no term has: ASCII other than digits and letters.
APART = np.ones(256, bool)
APART[128:] = False
for _first, _last in (b"09", b"AZ", b"az"):
    APART[_first : _last + 1] = False

#: Documents and postings that fill a shard, and terms of all queries of a block.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_TERMS = 1 << 15, 1 << 22, 1 << 20
#: Results that a task holds before it drops all but the best of each query.
HELD = 1 << 18
#: Dealt into so many parts, the best of a query's tasks are first merged by part.
PARTS = 64
#: Null ids count as larger than any id.
LAST = 2**63 - 1

SHARDS = "n_docs long, n_terms long, ids binary, lengths binary, terms binary, ends binary, docs binary, counts binary"
FOUND = "query int, doc_id long, score long"


def terms_of(texts: Texts) -> Iterator[tuple[int, Texts]]:
    """Parts of the texts with their terms found, hashed twice over; each with its first text's number."""
    for first, part in texts.pieces(APART):
        part.words(fold=True, seeds=(0, 1), space=APART)
        yield first, part


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        for first, piece in terms_of(texts):
            item = pa.array(np.repeat(np.arange(len(piece)) + first, np.diff(piece.first)))
            yield pa.RecordBatch.from_pydict({"item_id": part.column("item_id").take(item), "key1": pa.array(piece.hashes.view(np.int64)), "key2": pa.array(piece.more[0].view(np.int64))})


class Vocabulary:
    """The terms of a block of queries: sorted keys, and each query's terms by place among them."""

    def __init__(self, items: np.ndarray, key1: np.ndarray, key2: np.ndarray):
        keys = np.unique(np.stack([key1, key2], 1), axis=0)
        self.key1, self.key2 = keys[:, 0].copy(), keys[:, 1].copy()
        # a first key that two terms share: the second tells them apart, one step further on
        self.most_alike = int(np.max(np.bincount(np.unique(self.key1, return_inverse=True)[1]), initial=1))
        self.items, query = np.unique(items, return_inverse=True)
        term = self.find(key1, key2)
        order = np.lexsort((term, query))
        self.query_terms, self.query_ends = term[order], np.cumsum(np.bincount(query, minlength=len(self.items)))

    def __len__(self) -> int:
        return len(self.key1)

    def find(self, key1: np.ndarray, key2: np.ndarray) -> np.ndarray:
        """Places of terms, -1 for those that no query has."""
        found = np.full(len(key1), -1, np.int64)
        at = np.searchsorted(self.key1, key1)
        for step in range(self.most_alike):
            near = np.minimum(at + step, len(self) - 1)
            same = (self.key1[near] == key1) & (self.key2[near] == key2)
            found[same] = near[same]
        return found


class _Shard:
    """Documents of a shard to be: their ids and lengths, and term, document and count of postings."""

    def __init__(self):
        self.ids, self.lengths, self.parts, self.postings, self.n_docs, self.n_terms = [], [], [], 0, 0, 0

    def add(self, ids: np.ndarray, texts: Texts, vocabulary: Vocabulary) -> None:
        base, lengths = sum(map(len, self.ids)), np.zeros(len(texts), np.int64)
        keys = []
        for first, piece in terms_of(texts):
            lengths[first : first + len(piece)] += np.diff(piece.first)
            document = np.repeat(np.arange(len(piece)) + first, np.diff(piece.first))
            term = vocabulary.find(piece.hashes, piece.more[0])
            known = term >= 0
            keys.append(np.unique(term[known] << 32 | (document[known] + base), return_counts=True))
        self.n_docs, self.n_terms = self.n_docs + int((lengths > 0).sum()), self.n_terms + int(lengths.sum())
        # a long text's parts each have their own counts of it
        key, count = np.concatenate([k for k, _ in keys] or [np.zeros(0, np.int64)]), np.concatenate([c for _, c in keys] or [np.zeros(0, np.int64)])
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.parts.append((key, count))
        self.postings += len(key)

    def full(self) -> bool:
        return sum(map(len, self.ids)) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def packed(self) -> pa.RecordBatch:
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        key, count = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        key, at = np.unique(key, return_inverse=True)
        count = np.bincount(at, count, len(key)).astype(np.int64)
        # documents are in order of id, so that of equal scores the first is the smallest id
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        term, document = key >> 32, place[key & 0xFFFFFFFF]
        sort = np.lexsort((document, term))
        term, document, count = term[sort], document[sort], count[sort]
        there, size = np.unique(term, return_counts=True)
        packed = {"ids": ids[order], "lengths": lengths[order], "terms": there.astype(np.int32), "ends": np.cumsum(size), "docs": document.astype(np.int32), "counts": count}
        return pa.RecordBatch.from_pydict({"n_docs": pa.array([self.n_docs], pa.int64()), "n_terms": pa.array([self.n_terms], pa.int64())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in packed.items()})


def _sharder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, shard = shared.value, _Shard()
        for part, texts in slices(batches):
            shard.add(part.column("doc_id").to_numpy(), texts, vocabulary)
            if shard.full():
                yield shard.packed()
                shard = _Shard()
        if shard.ids:
            yield shard.packed()

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per term, of each shard."""
    for batch in batches:
        for terms, ends in zip(batch.column("terms").to_pylist(), batch.column("ends").to_pylist()):
            yield pa.RecordBatch.from_pydict({"term": np.frombuffer(terms, np.int32).astype(np.int64), "df": np.diff(np.frombuffer(ends, np.int64), prepend=0)})


def impacts(count: np.ndarray, length: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each posting adds to the score of its document."""
    m = 100 - 90 + (90 * length * n_docs) // n_terms
    return weight * ((1_000_000_000 * count) // (1000 * count + 8 * m))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of equal ones the first."""
    some = np.flatnonzero(scores > 0)
    if len(some) <= k:
        return some
    value = scores[some]
    last = value[np.argpartition(value, len(value) - k)[len(value) - k]]
    above, tied = some[value > last], some[value == last]
    return np.concatenate([above, tied[: k - len(above)]])


def _few(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    return query[rank < k], ids[rank < k], scores[rank < k]


def _searcher(shared, weights, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight = shared.value, weights.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row in batch.to_pylist():
                ids, length, ends, counts = (np.frombuffer(row[c], np.int64) for c in ("ids", "lengths", "ends", "counts"))
                terms, docs = (np.frombuffer(row[c], np.int32) for c in ("terms", "docs"))
                value = impacts(counts, length[docs], np.repeat(weight[terms], np.diff(ends, prepend=0)), n_docs, n_terms)
                end = np.zeros(len(vocabulary) + 1, np.int64)
                end[terms + 1] = np.diff(ends, prepend=0)
                end = np.cumsum(end)
                first = 0
                for query, last in enumerate(vocabulary.query_ends):
                    scores = np.zeros(len(ids), np.int64)
                    for term in vocabulary.query_terms[first:last]:
                        a, b = end[term], end[term + 1]
                        if a < b:
                            scores[docs[a:b]] += value[a:b]
                    at, first = best(scores, k), last
                    if len(at):
                        held.append((np.full(len(at), query), ids[at], scores[at]))
                if sum(len(x[0]) for x in held) > HELD:
                    held = [_few(*map(np.concatenate, zip(*held)), k)]
        if held:
            query, ids, scores = _few(*map(np.concatenate, zip(*held)), k)
            yield pa.RecordBatch.from_pydict({"query": pa.array(query.astype(np.int32)), "doc_id": pa.array(ids), "score": pa.array(scores)})

    return run


def _block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``item_id, doc_id, score`` for one block of queries (item, key1, key2)."""
    spark = docs.sparkSession
    rows = asked.toPandas()  # BLOCK_TERMS rows, and one query's at most
    vocabulary = Vocabulary(rows["item"].to_numpy(), *(rows[c].to_numpy().view(np.uint64) for c in ("key1", "key2")))
    shared = spark.sparkContext.broadcast(vocabulary)
    shards = cut(docs.mapInArrow(_sharder(shared), SHARDS))
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    counted = shards.select("terms", "ends").mapInArrow(_postings, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = np.zeros(len(vocabulary), np.int64)
    for r in counted.toLocalIterator():
        weight[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    found = shards.mapInArrow(_searcher(shared, spark.sparkContext.broadcast(weight), n_docs, n_terms, k), FOUND)
    names = spark.createDataFrame([(n, int(item)) for n, item in enumerate(vocabulary.items)], "query int, item long")
    return found.join(F.broadcast(names), "query").select("item", "doc_id", "score")


def _top(found: DataFrame, keys: list[str | Column], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """For every query its k highest-scoring documents with a score above 0: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII digits and letters and of all characters beyond ASCII, A-Z lower-cased; a
    query's terms count once, queries with equal ids are one, and one without an id takes no part. Null
    and empty texts have no terms: such documents are not counted, and such queries have no rows. Equal
    scores are in order of id; null ids count as largest, rows with equal ids are documents each. Texts of
    any length count whole. Other columns are ignored, whatever their names. Empty tables give an empty result.
    """
    taken = queries.select(column(queries, query_id_col, "bigint").alias("item_id"), column(queries, query_text_col, "string").alias("text")).filter("item_id is not null")
    asked = cut(taken.mapInArrow(_item_terms, "item_id long, key1 long, key2 long").distinct())
    # one row per query: their running sum deals them into blocks
    sizes = asked.groupBy("item_id").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1))
    blocks = cut(sizes.select("item_id", F.floor(F.coalesce(upto, F.lit(0)) / BLOCK_TERMS).alias("block")))
    texts = docs.select(F.coalesce(column(docs, id_col, "bigint"), F.lit(LAST)).alias("doc_id"), column(docs, text_col, "string").alias("text"))
    found = None
    for block in range((blocks.agg(F.max("block")).first()[0] or 0) + 1 if asked.take(1) else 0):
        made = _block(texts, asked.join(blocks.filter(F.col("block") == block), "item_id").select(F.col("item_id").alias("item"), "key1", "key2"), k)
        found = made if found is None else found.unionByName(made)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    few = _top(found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), ["item", "part"], k).drop("rank", "part")
    return _top(few, ["item"], k).select(F.col("item").alias("item_id"), F.col("rank").cast("int"), F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents),
f AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
z AS (SELECT count(*) AS c, sum(n)::BIGINT AS l FROM n),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
w AS (SELECT t, floor(1000 * ln((2 * c + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM f GROUP BY t), z),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * c) // l))))::BIGINT AS score
    FROM q JOIN w USING (t) JOIN f USING (t) JOIN n USING (doc_id), z GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
