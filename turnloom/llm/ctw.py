"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. Each decision has a node in the tree of every context, which is the
byte's last 0, 1, .. DEPTH bytes, and every node estimates the decision by its counts, as Krichevsky and
Trofimov do. A node's weighted probability is the mean of its own estimate's and of the product of its
children's, the contexts longer by a byte; so all depths are mixed, each as far as the corpus bears it
out. Counts do not depend on the order of the corpus, so the tree is fitted by counting runs of bytes.

What is gathered are the distinct runs of DEPTH + 1 bytes of all documents, with how often the training
documents have them, most recent context byte first. Sorted so, a context is a prefix and its subtree a
stretch of rows: tasks hold whole subtrees of two bytes and work from the leaves up; nodes of the two
levels above are at most 256 trees of 255, and are put together on the driver. Then every run has the
logarithm of its last byte's probability, which is what a text's sum needs.

Documents are scored in slices of bounded size, each packed into one row. A slice asks once for each run
(and word) that it has; the answers are joined by key, and meet the slice, which is read once more. Neither the
model nor an answer is ever broadcast, and no row is made for a position.

A text ends with a mark that no text holds, and begins after such marks, so scores are of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import Texts, column, cut, cut_at, delete, ragged, slices

#: Bytes of context, and of the contexts whose subtrees a task holds whole.
DEPTH, ROOT = 5, 2
#: Bytes of text in a slice, bytes worked on at a time, and runs that a task works on together, about.
SLICE, CHUNK, TOGETHER = 1 << 25, 1 << 19, 1 << 18
#: Stands before and after every text; no UTF-8 has it.
MARK = 0xFF
#: Second key of runs; words have one of 0 or more.
RUN = -1

_LN2, _LN10 = np.log(2.0), np.log(10.0)
ASKED = "slice long, key1 long, key2 int, n long"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def runs_of(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every byte of the texts, and the mark at each end, the number of its text and its run: the
    bytes before it, the nearest first, and the byte itself."""
    lengths = np.diff(texts.offsets)
    gap = bytes([MARK]) * DEPTH
    data = np.frombuffer(gap + b"".join([p for i in range(len(texts)) for p in (texts.text(i), gap)]), np.uint8)
    data = lower(data)
    first = DEPTH + np.cumsum(lengths + DEPTH) - (lengths + DEPTH)
    for at in range(DEPTH, len(data), CHUNK):
        # places in this part, of bytes or of the first mark after a text
        to = min(at + CHUNK, len(data))
        a, b = int(np.searchsorted(first, at, "right")) - 1, int(np.searchsorted(first, to))
        start, end = np.maximum(first[a:b], at), np.minimum(first[a:b] + lengths[a:b] + 1, to)
        count = np.maximum(end - start, 0)
        some = ragged(start - at, count)
        key = data[at - 1 : to - 1].astype(np.uint64)
        for back in range(2, DEPTH + 1):
            key <<= np.uint64(8)
            key |= data[at - back : to - back]
        key <<= np.uint64(8)
        key |= data[at:to]
        yield np.repeat(np.arange(a, b), count), key[some].view(np.int64)


def words_of(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every word the number of its text and its two keys, part by part."""
    for first, piece in texts.pieces():
        piece.words(fold=True, seeds=(0, 1))
        yield np.repeat(np.arange(len(piece)) + first, np.diff(piece.first)), piece.hashes.view(np.int64), (piece.more[0] >> np.uint64(33)).astype(np.int32)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows packed into slices, one row each: a new one begins with the part that would overfill the last.
    A part is packed as it comes, so that no slice is held as it was read."""
    number, size, out = TaskContext.get().partitionId() << 32, 0, None

    def slice_() -> pa.RecordBatch:
        stream.close()
        packed = out.getvalue()
        ends = pa.py_buffer(np.array([0, packed.size], np.int64))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.LargeBinaryArray.from_buffers(pa.large_binary(), 1, [None, ends, packed])], names=["slice", "rows"])

    for part, texts in slices(batches):
        if out and size + len(texts.data) > SLICE:
            yield slice_()
            number, size, out = number + 1, 0, None
        if not out:
            out = pa.BufferOutputStream()
            stream = pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        stream.write_batch(part)
        size += len(texts.data) + len(texts)
    if out:
        yield slice_()


def _rows_of(blobs: pa.Array) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The documents of slices, part by part."""
    for blob in blobs:
        with pa.ipc.open_stream(blob.as_buffer()) as stream:
            yield from slices(stream, size=CHUNK)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Parts of (key1, key2, n), or of (key1, n), as one: distinct keys in order, and the sums of n. The
    list is emptied."""
    *keys, n = (np.concatenate([p[k] for p in parts]) for k in range(len(parts[0])))
    parts.clear()
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    keys = [k[order] for k in keys]
    new = np.zeros(len(n), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    return (*(k[start] for k in keys), np.add.reduceat(n[order], start) if len(n) else n)


class _Sums:
    """Sums by key, of parts that are put together as they fill up, so that what is held is bounded by the
    distinct keys and not by how often they came."""

    def __init__(self, keys: int):
        self.whole, self.fresh, self.rows = (np.zeros(0, np.int64),) * (keys + 1), [], 0

    def add(self, *part: np.ndarray) -> None:
        self.fresh.append(part)
        self.rows += len(part[0])
        if self.rows > max(2 * TOGETHER, len(self.whole[0]) // 2):
            self._together()

    def _together(self) -> None:
        parts, self.whole, self.fresh, self.rows = [self.whole, *self.fresh], (), [], 0
        self.whole = _summed(parts)

    def done(self) -> Iterator[tuple[np.ndarray, ...]]:
        """The sums, in order and in parts of bounded size."""
        self._together()
        whole, self.whole = self.whole, ()
        for at in range(0, len(whole[0]), TOGETHER):
            yield tuple(column[at : at + TOGETHER] for column in whole)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs and words of each slice, once, with how often its training documents have them."""
    for batch in batches:
        for number, blob in zip(batch.column("slice").to_pylist(), batch.column("rows")):
            runs, words = _Sums(1), _Sums(2)
            for part, texts in _rows_of([blob]):
                train = ~part.column("held_out").to_numpy(zero_copy_only=False)
                for text, run in runs_of(texts):
                    code, key = pd.factorize(run)
                    runs.add(key, np.bincount(code, train[text], len(key)).astype(np.int64))
                for text, key1, key2 in words_of(texts):
                    words.add(*_summed([(key1, key2, train[text].astype(np.int64))]))
            for run, n in runs.done():
                yield pa.RecordBatch.from_pydict({"slice": pa.array(np.full(len(run), number)), "key1": pa.array(run), "key2": pa.array(np.full(len(run), RUN, np.int32)), "n": pa.array(n)})
            for key1, key2, n in words.done():
                yield pa.RecordBatch.from_pydict({"slice": pa.array(np.full(len(key1), number)), "key1": pa.array(key1), "key2": pa.array(key2.astype(np.int32)), "n": pa.array(n)})


# -- the tree ------------------------------------------------------------------------------------------


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series from x + 8 on."""
    z, below = x + 8, np.ones_like(x)
    for k in range(8):
        below = below * (x + k)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9) - np.log(below)


def ln_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the estimate's probability of a sequence with so many zeros and ones."""
    return ln_gamma(a + 0.5) + ln_gamma(b + 0.5) - np.log(np.pi) - ln_gamma(a + b + 1.0)


class Level:
    """The nodes of one depth, for runs that are distinct and in order: counts, and the weighted
    probability of each, by bit of the byte."""

    def __init__(self, runs: np.ndarray, n: np.ndarray):
        self.runs, self.n = runs, n
        self.node: list[np.ndarray] = []  # of each run, by bit
        self.first: list[np.ndarray] = []  # a run of each node
        self.zeros: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        for bit in range(8):
            prefix = runs >> np.uint64(8 - bit)
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            start = np.flatnonzero(new)
            one = (runs >> np.uint64(7 - bit)) & np.uint64(1) > 0
            ones = np.add.reduceat(np.where(one, n, 0), start).astype(np.float64)
            self.node.append(np.cumsum(new) - 1)
            self.first.append(start)
            self.ones.append(ones)
            self.zeros.append(np.add.reduceat(n, start).astype(np.float64) - ones)
        self.own = [ln_kt(a, b) for a, b in zip(self.zeros, self.ones)]
        self.ln_weighted = self.own  # of leaves; else see mixed

    def mixed(self, below: list[np.ndarray]) -> None:
        """below: the sum of the children's ln, of each node."""
        self.ln_weighted = [np.logaddexp(p, q) - _LN2 for p, q in zip(self.own, below)]

    def stays(self, bit: int) -> np.ndarray:
        """How much of a node's mean is its own estimate."""
        return np.exp(self.own[bit] - _LN2 - self.ln_weighted[bit])

    def says(self, bit: int) -> np.ndarray:
        """For each run the estimate of its own next bit."""
        at = self.node[bit]
        one = (self.runs >> np.uint64(7 - bit)) & np.uint64(1) > 0
        return (np.where(one, self.ones[bit][at], self.zeros[bit][at]) + 0.5) / (self.zeros[bit][at] + self.ones[bit][at] + 1)


def subtrees(runs: np.ndarray, n: np.ndarray) -> tuple[list[Level], list[np.ndarray]]:
    """Levels from DEPTH down to ROOT for whole subtrees, and of each level's runs the place in the next
    one, of a context shorter by its oldest byte."""
    levels, to = [Level(runs, n)], []
    for _ in range(DEPTH - ROOT):
        last = levels[-1]
        shorter = last.runs >> np.uint64(16) << np.uint64(8) | last.runs & np.uint64(0xFF)
        kept, at = np.unique(shorter, return_inverse=True)
        level = Level(kept, np.bincount(at, last.n, len(kept)).astype(np.int64))
        level.mixed([np.bincount(level.node[bit][at[last.first[bit]]], last.ln_weighted[bit], len(level.own[bit])) for bit in range(8)])
        levels.append(level)
        to.append(at)
    return levels, to


def _whole_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs, in order, and their counts, in parts that hold subtrees whole."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    shift = np.uint64(8 * (DEPTH - ROOT + 1))
    for batch in batches:
        runs, n = batch.column("key1").to_numpy().view(np.uint64), batch.column("n").to_numpy()
        if not len(runs):
            continue
        held.append((runs, n))
        if sum(len(h[0]) for h in held) < TOGETHER:
            continue
        runs, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        root = runs >> shift
        end = int(np.searchsorted(root, root[-1]))
        if end:
            yield runs[:end], n[:end]
        held = [(runs[end:], n[end:])]
    if held:
        runs, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        yield runs, n


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the level above needs of subtrees: its runs' counts (bit -1), and per node the sum of ln."""
    for runs, n in _whole_subtrees(batches):
        levels, _ = subtrees(runs, n)
        last = levels[-1]
        shorter = last.runs >> np.uint64(16) << np.uint64(8) | last.runs & np.uint64(0xFF)
        rows = [(shorter, np.full(len(shorter), -1), last.n, np.zeros(len(shorter)))]
        for bit in range(8):
            first = last.first[bit]
            prefix = shorter[first] >> np.uint64(8 - bit)
            rows.append((prefix, np.full(len(first), bit), np.zeros(len(first), np.int64), last.ln_weighted[bit]))
        node, bit, count, ln = (np.concatenate([r[k] for r in rows]) for k in range(4))
        yield pa.RecordBatch.from_pydict({"node": pa.array(node.view(np.int64)), "bit": pa.array(bit.astype(np.int32)), "n": pa.array(count), "ln": pa.array(ln)})


class Top:
    """The levels of contexts of one byte and of none, as tables by node."""

    def __init__(self, rows: pd.DataFrame):
        counts = rows[rows.bit == -1].sort_values("node")
        one = Level(counts.node.to_numpy().view(np.uint64), counts.n.to_numpy())
        below = []
        for bit in range(8):
            own = rows[rows.bit == bit].sort_values("node")
            below.append(own.ln.to_numpy())  # the same nodes, in the same order
        one.mixed(below)
        short, at = np.unique(one.runs & np.uint64(0xFF), return_inverse=True)
        none = Level(short, np.bincount(at, one.n, len(short)).astype(np.int64))
        none.mixed([np.bincount(none.node[bit][at[one.first[bit]]], one.ln_weighted[bit], len(none.own[bit])) for bit in range(8)])
        self.runs = one.runs
        # for each run of one byte of context: the share and estimate of both levels, by bit
        self.shares = [(none.stays(bit)[none.node[bit]][at], none.says(bit)[at], one.stays(bit)[one.node[bit]], one.says(bit)) for bit in range(8)]


def _valued(shared):
    """log10 of the probability of each run's byte after its context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for runs, n in _whole_subtrees(batches):
            levels, to = subtrees(runs, n)
            last = levels[-1].runs
            place = np.searchsorted(top.runs, last >> np.uint64(16) << np.uint64(8) | last & np.uint64(0xFF))
            total = np.zeros(len(runs))
            for bit in range(8):
                # from the root of the subtrees down: how much is left for longer contexts
                w0, p0, w1, p1 = (x[place] for x in top.shares[bit])
                got, left = w0 * p0 + (1 - w0) * w1 * p1, (1 - w0) * (1 - w1)
                for k in range(len(levels) - 1, -1, -1):
                    level = levels[k]
                    stays = level.stays(bit)[level.node[bit]] if k else np.ones(len(level.runs))
                    got, left = got + left * stays * level.says(bit), left * (1 - stays)
                    if k:
                        got, left = got[to[k - 1]], left[to[k - 1]]
                total += np.log(got)
            yield pa.RecordBatch.from_pydict({"key1": pa.array(runs.view(np.int64)), "key2": pa.array(np.full(len(runs), RUN, np.int32)), "value": pa.array(total / _LN10)})

    return run


def run_values(runs: DataFrame) -> DataFrame:
    """``key1, key2, value`` of distinct runs (key1, n): log10 of the byte's probability in its context."""
    whole = cut(runs).repartition(F.shiftright("key1", 8 * (DEPTH - ROOT + 1))).sortWithinPartitions("key1")
    roots = whole.mapInArrow(_roots, "node long, bit int, n long, ln double").groupBy("node", "bit").agg(F.sum("n").alias("n"), F.sum("ln").alias("ln"))
    rows = roots.toPandas()  # nodes of 256 trees at most
    if not len(rows):
        return runs.sparkSession.createDataFrame([], "key1 long, key2 int, value double")
    return whole.mapInArrow(_valued(runs.sparkSession.sparkContext.broadcast(Top(rows))), "key1 long, key2 int, value double")


# -- scores --------------------------------------------------------------------------------------------


def _scorer(train_tokens: int, train_docs: int, distinct: int):
    def ln(count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (train_tokens + 0.1 * (distinct + 1)))

    def looked_up(keys: list[np.ndarray], known: list[np.ndarray], value: np.ndarray) -> np.ndarray:
        """The values of rows of keys, all of which are known: known is in order of both keys."""
        at = np.searchsorted(known[0], keys[0])
        if len(keys) > 1:
            for _ in range(8):  # words of an equal first key stand together
                wrong = known[1][np.minimum(at, len(value) - 1)] != keys[1]
                if not wrong.any():
                    break
                at = at + wrong
        return value[np.minimum(at, len(value) - 1)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.filter(pc.equal(right.column("key2"), RUN)).sort_by("key1")
        runs, run_value = [known.column("key1").to_numpy()], known.column("value").to_numpy()
        known = right.filter(pc.not_equal(right.column("key2"), RUN)).sort_by([("key1", "ascending"), ("key2", "ascending")])
        words, word_value = [known.column(c).to_numpy() for c in ("key1", "key2")], known.column("value").to_numpy()
        del known, right
        out = []
        for part, texts in _rows_of(left.column("rows")):
            score, base = np.zeros(len(texts)), np.zeros(len(texts))
            tokens, known = np.ones(len(texts), np.int64), np.full(len(texts), int(train_docs > 0), np.int64)
            for text, key in runs_of(texts):
                code, found = pd.factorize(key)
                score += np.bincount(text, looked_up([found], runs, run_value)[code], len(texts))
            for text, one, two in words_of(texts):
                if len(text):
                    count = looked_up([one, two], words, word_value)
                    base += np.bincount(text, ln(count), len(texts))
                    tokens += np.bincount(text, minlength=len(texts))
                    known += np.bincount(text, count > 0, len(texts)).astype(np.int64)
            base += ln(np.array([float(train_docs)]))[0]
            out.append(pa.table({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": tokens, "n_known": known, "train_tokens": pa.array([train_tokens] * len(texts), pa.int64()), "base_score": base, "score": score}))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    return run


def every_tenth(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learned from: a checksum of the id is divisible by ten. Null ids too."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("bigint").cast("string").cast("binary")) % 10 == 0, F.lit(True))


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """One row per row of df: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from rows that are not held out (by default a tenth of the ids are). A-Z are lower-cased. score is
    log10 of the probability that context-tree weighting gives to the text's bytes and its end: divided
    by their number, a code length per byte. Tokens are runs of bytes other than space and the controls
    from tab to carriage return, and one end; base_score is that of their smoothed frequencies alone.
    Null and empty texts have an end only. Rows without an id are held out; repeated rows each count.
    Texts of any length count whole. Without anything to learn from every bit is even. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    rows = df.select(column(df, id_col, "bigint").alias("doc_id"), (every_tenth(id_col) if held_out is None else held_out).alias("held_out"), column(df, text_col, "string").alias("text"))
    texts = cut(rows.mapInArrow(_sliced, "slice long, rows binary"))
    asked, asked_at = cut_at(texts.mapInArrow(_asked, ASKED), "zstd")
    words = asked.filter(F.col("key2") != RUN).groupBy("key1", "key2").agg(F.sum("n").alias("value"))
    words = cut(words.withColumn("value", F.col("value").cast("double")))
    counts = words.agg(F.coalesce(F.sum("value"), F.lit(0.0)).cast("long").alias("n"), F.count_if(F.col("value") > 0).alias("v")).first()
    docs = rows.agg(F.count_if(~F.col("held_out"))).first()[0]
    runs = run_values(asked.filter(F.col("key2") == RUN).groupBy("key1").agg(F.sum("n").alias("n")))
    values = cut(runs).unionByName(words)
    answers = cut_at(asked.select("slice", "key1", "key2").join(values, ["key1", "key2"]), "zstd")[0]
    delete(df.sparkSession, asked_at)
    scorer = _scorer(counts.n + docs, docs, counts.v + (docs > 0))
    return texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(scorer, SCHEMA)
