"""Merkle manifest of a table: a digest per row, a tree per source, a tree over the sources, and proofs.

Leaves are numbered by source and id: a range shuffle puts them in order, and counts of its parts give
each row its place. The trees are then made by events. A digest that is done is an event to its parent;
parents are partial until as many children have come as the size of the tree says, and then emit their
own digest as the next event. ``combineByKey`` folds the events of all leaves under one node three
levels up (4,096 at most): what a task has of them first, then the rest after the shuffle. What is done
there is the frontier that is shuffled again, for the three levels above, until one node is left. Sources'
roots are the leaves of one more tree.

Blocks keep the digests of their nodes, by level and place: these are the links back from parents to
children. From the top down each block takes the path above it and hands the paths of its nodes to the
blocks below, so a leaf's proof is made where its block is, and no proof is shuffled for a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import column, cut

ARITY_BITS, SPAN = 4, 3
ARITY, BLOCK_BITS = 1 << ARITY_BITS, ARITY_BITS * SPAN
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BLOCKS = "tree long, block long, n long, digests array<array<string>>, top string, ids array<long>, tampered array<string>"
PATHS = "tree long, block long, subroot string, path array<struct<pos:int,others:string>>"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def counted(n: int, level: int) -> int:
    """Nodes of a tree of n leaves so many levels up."""
    return -(-n >> ARITY_BITS * level) if n >= 0 else 0


class Block:
    """Nodes of up to three levels over a run of leaves: digests by level and place, and how many
    children each partial parent has."""

    __slots__ = ("n", "nodes", "children", "rows")

    def __init__(self, n: int):
        self.n = n
        self.nodes: list[dict[int, str]] = [{} for _ in range(SPAN + 1)]
        self.children: list[dict[int, int]] = [{} for _ in range(SPAN + 1)]
        self.rows: dict[int, tuple] = {}

    def _arity(self, level: int, place: int) -> int:
        return min(ARITY, -(-self.n >> ARITY_BITS * (level - 1)) - place * ARITY)

    def _emit(self, level: int, place: int) -> str:
        first, below = place * ARITY, self.nodes[level - 1]
        return digest("".join([below[k] for k in range(first, first + self._arity(level, place))]))

    def event(self, level: int, place: int, value: str) -> Block:
        """A node is done: its parent counts it, and is done itself with the last of its children."""
        while True:
            self.nodes[level][place] = value
            if level == SPAN or counted(self.n, level) == 1:
                return self
            level, place = level + 1, place >> ARITY_BITS
            have = self.children[level][place] = self.children[level].get(place, 0) + 1
            if have < self._arity(level, place):
                return self
            value = self._emit(level, place)

    def leaf(self, row: tuple) -> Block:
        place, value, ident, tampered = row
        self.rows[place] = (ident, tampered)
        return self.event(0, place, value)

    def merge(self, other: Block) -> Block:
        """Takes over another task's nodes; parents that only both together complete emit now."""
        self.rows.update(other.rows)
        for level in range(SPAN + 1):
            self.nodes[level].update(other.nodes[level])
            for place, n in other.children[level].items():
                self.children[level][place] = self.children[level].get(place, 0) + n
        for level in range(1, SPAN + 1):
            for place, n in list(self.children[level].items()):
                if place not in self.nodes[level] and n == self._arity(level, place):
                    self.event(level, place, self._emit(level, place))
        return self


def _row(item: tuple) -> tuple:
    (tree, block), made = item
    levels = [[level[k] for k in sorted(level)] for level in made.nodes]
    levels = [v for v in levels if v]
    rows = [made.rows[k] for k in sorted(made.rows)]
    return tree, block, made.n, levels, levels[-1][0], [r[0] for r in rows], [r[1] for r in rows]


def blocks_of(events: DataFrame) -> DataFrame:
    """Blocks of events (tree, n, place, digest, doc_id, tampered)."""
    spark = events.sparkSession
    pairs = events.select("tree", "n", "place", "digest", "doc_id", "tampered").rdd.map(lambda r: ((r[0], r[2] >> BLOCK_BITS), (r[1], (r[2], r[3], r[4], r[5]))))
    made = pairs.combineByKey(lambda v: Block(v[0]).leaf(v[1]), lambda b, v: b.leaf(v[1]), Block.merge, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cut(spark.createDataFrame(made.map(_row), BLOCKS, verifySchema=False))


def trees(events: DataFrame, most: int) -> list[DataFrame]:
    """Blocks of all rounds, from the leaves up. most: leaves of the largest tree."""
    rounds = [blocks_of(events)]
    while most > 1 << BLOCK_BITS:
        most = counted(most, SPAN)
        below = rounds[-1].filter(F.col("n") > 1 << BLOCK_BITS)
        size = F.shiftright(F.col("n") + (1 << BLOCK_BITS) - 1, BLOCK_BITS)
        none = F.lit(None)
        rounds.append(blocks_of(below.select("tree", size.alias("n"), F.col("block").alias("place"), F.col("top").alias("digest"), none.cast("long").alias("doc_id"), none.cast("string").alias("tampered"))))
    return rounds


def _step(levels: list[list[str]], at: int) -> list[tuple[int, str]]:
    """The path of a block's leaf to its top: at each level its place in its run, and the others of it."""
    path = []
    for level in levels[:-1]:
        first = at & ~(ARITY - 1)
        run = level[first : first + ARITY]
        pos = at - first
        path.append((pos, "".join(run[:pos] + run[pos + 1 :])))
        at >>= ARITY_BITS
    return path


def _above(row: dict) -> list[tuple[int, str]]:
    return [(p["pos"], p["others"]) for p in row["path"] or []]


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's path to each of its leaves. The leaves of the tree over the sources are subroots."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("others", pa.string())]))
    for batch in batches:
        for row in batch.to_pylist():
            above, leaves, first = _above(row), row["digests"][0], row["block"] << BLOCK_BITS
            paths = [[{"pos": p, "others": o} for p, o in _step(row["digests"], k) + above] for k in range(len(leaves))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree"]] * len(leaves), pa.int64()), pa.array(range(first, first + len(leaves)), pa.int64()), pa.array([row["subroot"] or v for v in leaves]), pa.array(paths, kind)],
                names=["tree", "block", "subroot", "path"],
            )


def paths_to(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """``tree, block, subroot, path`` for every leaf of blocks: in ``block`` the leaf's place."""
    return cut(_joined(blocks, above).mapInArrow(_handed_down, PATHS))


def _joined(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    taken = ["tree", "block", "digests", "ids", "tampered"]
    if above is None:
        return blocks.select(*taken, F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("array<struct<pos:int,others:string>>").alias("path"))
    return blocks.select(*taken).join(above, ["tree", "block"])


def _proofs(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                above, leaves, proofs, folded = _above(row), row["digests"][0], [], []
                for k, (leaf, changed) in enumerate(zip(leaves, row["tampered"])):
                    path, value = _step(row["digests"], k) + above, changed or leaf
                    proofs.append(digest("".join([others for _, others in path])))
                    for pos, others in path:
                        value = digest(others[: 64 * pos] + value + others[64 * pos :])
                    folded.append(value)
                n = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(leaves), pa.array([row["subroot"]] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([v == root for v in folded])],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return run


def _field(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    """The digest of fields: each ``-`` if null, else its length in bytes, a colon and the value."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of leaves (doc_id, source, leaf, tampered), trees numbered by source, and the sources
    (tree, n). The table of runs has a row per source and part of the range shuffle."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    sorted_ = cut(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    runs = sorted_.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("have"))
    own = Window.partitionBy("source")
    before = F.coalesce(F.sum("have").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("start", before - F.col("first")).withColumn("n", F.sum("have").over(own))
    # one small row per source and part: their order gives each source its number
    runs = cut(runs.withColumn("tree", F.dense_rank().over(Window.orderBy(F.col("source").asc_nulls_first())).cast("long") - 1).drop("first", "have"))
    there = runs.withColumnsRenamed({"part": "_part", "source": "_source"})
    events = sorted_.join(there, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    return events.select("tree", "n", (F.col("start") + F.col("at")).alias("place"), F.col("leaf").alias("digest"), "doc_id", "tampered"), runs.select("tree", "n").distinct()


def manifest(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """One row per row of df: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    leaf is the digest of the fields; leaves of a source are in order of id (nulls first, then by leaf),
    and 16 consecutive digests of a level make one of the next until one is left, the subroot; a lone
    leaf is its own. Subroots, by source (null first), make the root alike. proof_sha256 is the digest
    of all siblings from the leaf up, folded_root what leaf and siblings give. Where ``tampered`` holds
    (by default never), the fold starts from a row whose text has A-Z lower-cased; verified tells whether
    it still comes to the root. Nulls of any field have a digest of their own; texts count whole; repeated
    rows are leaves each. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = df.sparkSession
    values = [column(df, name, "string") for name in fields]
    changed = [F.translate(v, UPPER, LOWER) if name == text_col else v for name, v in zip(fields, values)]
    spoiled = F.when(F.lit(False) if tampered is None else tampered, leaf_of(changed))
    leaves = cut(df.select(column(df, id_col, "bigint").alias("doc_id"), column(df, source_col, "string").alias("source"), leaf_of(values).alias("leaf"), spoiled.alias("tampered")))
    events, sources = placed(leaves)
    found = sources.agg(F.count("*").alias("n"), F.max("n").alias("most")).first()
    if not found.n:
        return spark.createDataFrame([], PROOFS)
    rounds = trees(events, found.most)
    tops = rounds[0].filter(F.col("n") <= 1 << BLOCK_BITS).select(F.lit(0).alias("round"), "tree", "top")
    for k, blocks in enumerate(rounds[1:], 1):
        tops = tops.unionByName(blocks.filter(F.col("n") <= 1 << BLOCK_BITS).select(F.lit(k).alias("round"), "tree", "top"))
    tops = cut(tops)
    none = F.lit(None)
    over = trees(tops.select(F.lit(0).cast("long").alias("tree"), F.lit(found.n).cast("long").alias("n"), F.col("tree").alias("place"), F.col("top").alias("digest"), none.cast("long").alias("doc_id"), none.cast("string").alias("tampered")), found.n)
    root = over[-1].select("top").first().top
    above = None
    for blocks in reversed(over):
        above = paths_to(blocks, above)
    # a source's path over the sources is for its top block, in whichever round that is
    given = cut(above.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), "subroot", "path").join(tops.select("tree", "round"), "tree"))
    above = None
    for k in range(len(rounds) - 1, 0, -1):
        own = given.filter(F.col("round") == k).drop("round")
        above = paths_to(rounds[k], own if above is None else own.unionByName(above))
    own = given.filter("round = 0").drop("round")
    return _joined(rounds[0], own if above is None else own.unionByName(above)).mapInArrow(_proofs(root), PROOFS)


def every_fifth(id_col: str = "doc_id") -> Column:
    """Rows whose id in decimals has a checksum that five divides; null ids have none."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("bigint").cast("string").cast("binary")) % 5 == 0, F.lit(False))


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

SQL = f"""
WITH RECURSIVE bits AS (SELECT range AS byte, 0 AS k, range::BIGINT AS c FROM range(256)
    UNION ALL SELECT byte, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
docs AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]))) % 5 = 0 AS odd FROM documents, steps),
leaves AS (SELECT doc_id, source, {_LEAF.format(text='text')} AS leaf,
    CASE WHEN odd THEN {_LEAF.format(text=f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM docs),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, dense_rank() OVER (ORDER BY source COLLATE "binary" NULLS FIRST) - 1 AS tree FROM leaves),
nodes AS (SELECT tree, 0 AS level, place::BIGINT AS place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM numbered
    UNION ALL SELECT tree, max(level) + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 15) // 16 FROM nodes WHERE n > 1 GROUP BY tree, place // 16),
tops AS (SELECT tree, digest AS subroot FROM nodes WHERE n = 1),
above AS (SELECT 0 AS level, tree::BIGINT AS place, subroot AS digest, count(*) OVER () AS n FROM tops
    UNION ALL SELECT max(level) + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 15) // 16 FROM above WHERE n > 1 GROUP BY place // 16),
runs AS (SELECT tree, level, place // 16 AS run, list(digest ORDER BY place) AS d FROM nodes WHERE n > 1 GROUP BY ALL),
above_runs AS (SELECT level, place // 16 AS run, list(digest ORDER BY place) AS d FROM above WHERE n > 1 GROUP BY ALL),
fold AS (SELECT doc_id, tree, leaf, 0 AS level, place::BIGINT AS place, '' AS proof, coalesce(changed, leaf) AS value FROM numbered
    UNION ALL SELECT f.doc_id, f.tree, f.leaf, f.level + 1, f.place // 16,
        f.proof || array_to_string(r.d[:f.place % 16], '') || array_to_string(r.d[f.place % 16 + 2:], ''),
        sha256(array_to_string(r.d[:f.place % 16], '') || f.value || array_to_string(r.d[f.place % 16 + 2:], ''))
    FROM fold f JOIN runs r ON r.tree = f.tree AND r.level = f.level AND r.run = f.place // 16),
subfold AS (SELECT doc_id, tree, leaf, proof, value FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id, tree, leaf ORDER BY level DESC) = 1),
rootfold AS (SELECT doc_id, tree, leaf, 0 AS level, tree::BIGINT AS place, proof, value FROM subfold
    UNION ALL SELECT f.doc_id, f.tree, f.leaf, f.level + 1, f.place // 16,
        f.proof || array_to_string(r.d[:f.place % 16], '') || array_to_string(r.d[f.place % 16 + 2:], ''),
        sha256(array_to_string(r.d[:f.place % 16], '') || f.value || array_to_string(r.d[f.place % 16 + 2:], ''))
    FROM rootfold f JOIN above_runs r ON r.level = f.level AND r.run = f.place // 16),
last AS (SELECT * FROM rootfold QUALIFY row_number() OVER (PARTITION BY doc_id, tree, leaf ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, value AS folded_root, value = root AS verified
FROM last JOIN tops USING (tree), (SELECT digest AS root FROM above WHERE n = 1)
"""
