"""Near-duplicate documents by b-bit MinHash.

A document's shingles are its distinct runs of five words. Of each of 128 hash functions the minimum
over the shingles is taken. Four whole minima make a band: documents that share one of 32 bands are
candidates, which two documents of similarity 0.75 miss once in 200,000 times. Of every minimum the
low four bits are kept, packed into eight integers; counting equal groups of bits, and correcting
for the one in sixteen that are equal by chance, estimates a candidate pair's similarity. Pairs that
come near the threshold are confirmed on the full sets.

Groups of copies make neither all their pairs nor one large task. Documents with the same set count
as one. A band's bucket first links its members to one of them, drawn by hash and so another one in
every band. Confirmed links are contracted to components; then only members of a bucket that are
still in different components are compared, a few by a join and many in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from turnloom.llm.common import Texts, column, cut, long_lists, mix, ragged, sequence_hashes, slices, with_rows
from turnloom.llm.components import components, merged

WORDS = 5
BANDS, PER_BAND, BITS = 32, 4, 4
MINIMA = BANDS * PER_BAND
#: 100 * intersection >= THRESHOLD * union makes a link.
THRESHOLD = 75
#: Pairs with an estimate below this are not confirmed: over four standard deviations under 0.75.
LEAST_ESTIMATE = 0.58
#: Buckets with more members than LARGE are compared in blocks of about TILE.
LARGE, TILE = 64, 512

_random = np.random.Generator(np.random.PCG64(20240611))
_FLIP = _random.integers(0, 2**64, MINIMA, np.uint64)
_TIMES = _random.integers(0, 2**64, MINIMA, np.uint64) | np.uint64(1)

FEATURES = "row long, doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, bits array<long>"


def shingle_sets(texts: Texts, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of every text, in order, and where each text's start and end."""
    words, first = texts.hashes if seed == 0 else texts.more[seed - 1], texts.first
    found, ends = [], [0]
    counts = np.diff(first)
    runs = sequence_hashes(words, WORDS, seed)
    for i in range(len(texts)):
        a, n = int(first[i]), int(counts[i])
        if n >= WORDS:
            found.append(np.unique(runs[a : a + n - WORDS + 1]))
        elif n:
            found.append(sequence_hashes(words[a : a + n], n, seed))
        ends.append(ends[-1] + (len(found[-1]) if n else 0))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.array(ends)


def _minimum(sets: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k-th minimum of each set that starts at one of the places."""
    return np.minimum.reduceat((sets ^ _FLIP[k]) * _TIMES[k], at)


def _pack(bits: np.ndarray, k: int, least: np.ndarray) -> None:
    """Puts the low bits of the k-th minima into the packed signatures."""
    each = 64 // BITS
    # the low bits of a product see little of the hash, so the minimum is scrambled first
    bits[:, k // each] |= (mix(least) & np.uint64((1 << BITS) - 1)) << np.uint64(k % each * BITS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        texts.words(fold=True, seeds=(0, 1))
        sets, ends = shingle_sets(texts)
        other, other_ends = shingle_sets(texts, 1)
        counts = np.diff(ends)
        some = np.flatnonzero(counts)
        at = ends[:-1][some]
        key1, key2 = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
        bands, bits = np.zeros((len(some), BANDS), np.uint64), np.zeros((len(some), MINIMA * BITS // 64), np.uint64)
        if len(some):
            key1[some], key2[some] = np.add.reduceat(mix(sets), at), np.add.reduceat(mix(other), other_ends[:-1][some])
            for k in range(MINIMA):
                least = _minimum(sets, at, k)
                bands[:, k // PER_BAND] = mix(bands[:, k // PER_BAND] ^ mix(least + np.uint64(k)))
                _pack(bits, k, least)
        lists = lambda x: long_lists(x.ravel(), np.concatenate([[0], np.cumsum((counts > 0) * x.shape[1])]))  # noqa: E731, B023
        yield pa.RecordBatch.from_pydict({
            "row": part.column("row"), "doc_id": part.column("doc_id"), "n_shingles": pa.array(counts.astype(np.int64)),
            "key1": pa.array(key1.view(np.int64)), "key2": pa.array(key2.view(np.int64)), "bands": lists(bands), "bits": lists(bits),
        })


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets that confirm links: of other hashes than those that made the candidates."""
    for part, texts in slices(batches):
        texts.words(fold=True, seeds=(0, 1))
        yield pa.RecordBatch.from_pydict({"node": part.column("node"), "set": long_lists(*shingle_sets(texts, 1))})


def estimate(left: str, right: str, minima: int = MINIMA) -> Column:
    """The similarity that packed bits tell: equal groups counted, less what is equal by chance."""
    ones = sum(1 << k for k in range(0, 64, BITS))
    different: Column = F.lit(0)
    for k in range(minima * BITS // 64):
        x = F.col(left)[k].bitwiseXOR(F.col(right)[k])
        shift = 1
        while shift < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            shift *= 2
        different = different + F.bit_count(x.bitwiseAND(F.lit(ones).cast("long")))
    chance = 1 / (1 << BITS)
    return ((1 - different / F.lit(float(minima))) - chance) / (1 - chance)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one, two = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(one, "a").join(two, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            keep = []
            for i in range(batch.num_rows):
                x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
                # both are sorted and distinct: what repeats in the merged list is shared
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int(np.count_nonzero(merged[1:] == merged[:-1]))
                keep.append(100 * shared >= THRESHOLD * (len(merged) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of df: ``doc_id, n_shingles, component_id, kept``, and ``row``, the row's
    number: row_col where df has one.

    Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage
    return, with A-Z lower-cased. A text of fewer than five words has its whole sequence as its one
    shingle; null, empty and wordless texts have none and are linked with nothing. component_id is the
    smallest id that can be reached by links (null ids count as largest); kept is true for one row of
    a component, the first with that id. Rows with equal ids are separate rows. Other columns are
    ignored, whatever their names. An empty table gives an empty result. df is read several times, and
    without row_col is written once first if it is no Parquet table. A pair of similarity 0.75 shares
    no band once in 200,000 times, and is estimated too low once in 100,000 times.
    """
    taken = [column(df, id_col, "bigint").alias("doc_id"), column(df, text_col, "string").alias("text")]
    rows = with_rows(df, "row", taken) if row_col is None else df.select(*taken, column(df, row_col, "bigint").alias("row"))
    features = cut(rows.mapInArrow(_features, FEATURES))
    some = features.filter("n_shingles > 0")
    # rows with the same set are one node, named by the smallest row
    key = ["n_shingles", "key1", "key2"]
    nodes = cut(some.groupBy(*key).agg(F.min("row").alias("node")))
    first = some.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "bands", "bits")
    spread = first.select("node", "bits", F.posexplode("bands").alias("band", "bucket"))
    drawn = F.struct(F.xxhash64("node", "band").alias("draw"), F.col("node"))
    buckets = spread.select("node", "band", "bucket").groupBy("bucket").agg(F.count("*").alias("n"), F.min(drawn)["node"].alias("pivot")).filter("n > 1")
    members = cut(spread.select("node", "band", "bucket", "bits").join(buckets, "bucket"))
    inside = cut(members.select("node").distinct())
    sets = cut(rows.withColumnRenamed("row", "node").join(inside, "node", "left_semi").select("node", "text").mapInArrow(_sets, "node long, set array<long>"))
    bits = members.select("node", "bits").dropDuplicates(["node"])
    pairs = members.filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    pairs = pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), "a").join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b")
    pairs = pairs.filter(estimate("bits_a", "bits_b") >= LEAST_ESTIMATE).select("a", "b")
    links = cut(_confirmed(pairs, sets))
    parts = cut(components(links))
    rest = _rest(members, parts, sets, first.select("node", "bands"))
    parts = parts if rest is None else cut(merged(parts, cut(rest)))
    placed = some.join(nodes, key).select("row", "doc_id", "n_shingles", "node").join(parts, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node")).select("row", "doc_id", "n_shingles", "component")
    alone = features.filter("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("row").alias("component"))
    placed = cut(placed.unionByName(alone))
    best = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    return placed.join(best, "component").select("doc_id", "n_shingles", F.col("best.doc_id").alias("component_id"), (F.col("row") == F.col("best.row")).alias("kept"), "row")


def _tile(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between two blocks of one bucket: for each row on the left, one to each other component on
    the right that it is linked with."""
    links: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        square = lambda t, name: t.column(name).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(t.num_rows, -1)
        node_a, node_b = left.column("node").to_numpy(), right.column("node").to_numpy()
        part_a, part_b, minor_b = left.column("part").to_numpy(), right.column("part").to_numpy(), right.column("minor").to_numpy()
        bands_a, bands_b, bits_a, bits_b = square(left, "bands"), square(right, "bands"), square(left, "bits"), square(right, "bits")
        band = int(left.column("band")[0].as_py())
        sets_a, sets_b = left.column("set").combine_chunks(), right.column("set").combine_chunks()
        flat, ends = sets_b.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(sets_b.value_lengths().to_numpy())])
        ones = np.uint64(sum(1 << k for k in range(0, 64, BITS)))
        for i in range(len(node_a)):
            # a pair meets in every band that it shares; the first of them decides it
            other = np.flatnonzero((part_b != part_a[i]) & (~minor_b | (node_a[i] < node_b)))
            other = other[~(bands_b[other, :band] == bands_a[i, :band]).any(1)]
            x = bits_b[other] ^ bits_a[i]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            equal = 1 - np.bitwise_count(x & ones).sum(1) / MINIMA
            other = other[(equal - 1 / (1 << BITS)) / (1 - 1 / (1 << BITS)) >= LEAST_ESTIMATE]
            if not len(other):
                continue
            own, sizes = sets_a[i].values.to_numpy().view(np.uint64), ends[other + 1] - ends[other]
            values = flat[ragged(ends[other], sizes)]
            at = np.minimum(np.searchsorted(own, values), len(own) - 1)
            shared = np.add.reduceat((own[at] == values).astype(np.int64), np.cumsum(sizes) - sizes)
            linked = other[100 * shared >= THRESHOLD * (len(own) + sizes - shared)]
            _, one = np.unique(part_b[linked], return_index=True)
            links += [(int(node_a[i]), int(node_b[j])) for j in linked[one]]
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _rest(members: DataFrame, parts: DataFrame, sets: DataFrame, bands: DataFrame) -> DataFrame | None:
    """Links between members of a bucket that the first links leave in different components; None where all
    of a bucket are in one.

    The members outside a bucket's main component are held against all of it. Small buckets do so by a
    join. Large ones are cut into blocks, and a task compares two blocks: it makes a row for a link, and
    none for the pairs that it looks at. What no bucket needs is not planned: sets are not shuffled for it.
    """
    now = members.filter("n > 2").join(parts, "node", "left").select("bucket", "band", "node", "n", "pivot", "bits", F.coalesce("component", "node").alias("part"))
    sizes = now.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    main = main.select("bucket", F.col("main.part").alias("main"), (F.col("n") - F.col("main.n")).alias("n_minor"))
    seen = Observation()
    now = now.join(main, "bucket").withColumn("minor", F.col("part") != F.col("main"))
    now = cut(now.observe(seen, F.count_if(F.col("n") <= LARGE).alias("small"), F.count_if(F.col("n") > LARGE).alias("large")))
    found = [make(now, sets, bands) for size, make in (("small", _few), ("large", _many)) if seen.get[size]]
    return found[0].unionByName(found[1]) if len(found) == 2 else found[0] if found else None


def _few(now: DataFrame, sets: DataFrame, bands: DataFrame) -> DataFrame:
    """The links of _rest in small buckets."""
    fields = ("part", "bits", "minor")
    side = lambda df, to: df.select("bucket", F.col("node").alias(to), *(F.col(c).alias(f"{c}_{to}") for c in fields))
    small = now.filter((F.col("n") <= LARGE) & (F.col("node") != F.col("pivot")))
    new = (F.col("part_a") != F.col("part_b")) & (~F.col("minor_b") | (F.col("a") < F.col("b")))
    pairs = side(small.filter("minor"), "a").join(side(small, "b"), "bucket").filter(new & (estimate("bits_a", "bits_b") >= LEAST_ESTIMATE))
    return cut(_confirmed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets))


def _many(now: DataFrame, sets: DataFrame, bands: DataFrame) -> DataFrame:
    """The links of _rest in large buckets."""
    large = now.filter(F.col("n") > LARGE).join(sets, "node").join(bands, "node")
    blocks = lambda n: F.ceil(F.col(n) / F.lit(TILE)).cast("int")
    dealt = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    given = ["node", "part", "minor", "band", "bands", "bits", "set"]
    left = large.filter("minor").select("bucket", dealt("n_minor").alias("x"), each("n").alias("y"), *given)
    right = large.select(F.col("bucket").alias("bucket"), each("n_minor").alias("x"), dealt("n").alias("y"), *(F.col(c).alias(c) for c in given))
    key = ["bucket", "x", "y"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_tile, "a long, b long")


SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
parts AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM parts LEFT JOIN sizes USING (doc_id)
"""
