"""What the training-data operators share: shared-folder tables and words as flat numpy arrays.

Tables that cut lineage go to the folder named by ``spark.checkpoint.dir``, which all executors and
the driver share. Only where the session names none (tests on one machine) a temporary folder is set.
"""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Texts are worked on in slices of about this many bytes, so that numpy's temporaries stay small.
SLICE_BYTES = 1 << 20

#: Space, tab, line feed, vertical tab, form feed and carriage return end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        warnings.warn("spark.checkpoint.dir is not set: tables go to a folder of this machine, which on a cluster executors do not see", stacklevel=2)
        context.setCheckpointDir(tempfile.mkdtemp(prefix="turnloom-"))
        where = context.getCheckpointDir()
    return where.rstrip("/")


def cut_at(df: DataFrame, codec: str | None = None) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder and read again, and where it is: later jobs do not
    recompute it, and a lost executor costs a reread only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        # once the table stands, the shuffles that made it are of no more use
        spark.conf.set(CLEANUP, "true")
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again."""
    return cut_at(df)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Takes a table out of the shared folder, by whatever store the folder is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def named(name: str):
    """The column of that exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def column(df: DataFrame, name: str, kind: str):
    """df's column of that exact name, cast to kind."""
    return named(name).cast(kind)


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one: one that df has no column of, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Salts that are tried to tell a table's files apart by a part of their hash.
SALTS = 4


def _is_scan(df: DataFrame) -> bool:
    """Whether df is a table of files as it is, but for columns and filters: each row of it is one row of
    a file, unlike after a join or an explode."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and not {"_metadata", "_file", "_at"} & {c.lower() for c in df.columns}


def with_rows(df: DataFrame, name: str, columns: list | None = None) -> DataFrame:
    """The columns of df (all by default) and ``name``, numbers of rows that are the same however often
    and on whatever cores the table is read.

    Rows of a Parquet table are known by their file and their place in it, so nothing is written: the
    number is a hash of the file's path and the place, in as many bits as the longest file needs. A pass
    over the places, and one over the paths for each salt tried, make sure that no two files share a hash;
    of several salts the first that tells them apart is taken, which one does up to some millions of files. Tables beyond that, and any
    that is no plain scan, are numbered once and written.
    """
    columns = [named(c) for c in df.columns] if columns is None else columns
    if _is_scan(df):
        path = F.col("_metadata.file_path")
        salted = lambda k: F.xxhash64(path, F.lit(k))
        try:
            bits = df.agg(F.max("_metadata.row_index")).first()[0]
        except AnalysisException:  # files that do not number their rows
            bits = None
        if bits is not None:
            bits = max(1, int(bits).bit_length())
            files = lambda k: df.select(path.alias("_file"), F.shiftrightunsigned(salted(k), bits + 1).alias("_hash")).distinct()
            salt = next((k for k in range(SALTS) if files(k).groupBy("_hash").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] == 1), None)
            if salt is not None:
                # one bit is left for the sign
                number = F.shiftleft(F.shiftrightunsigned(salted(salt), bits + 1), bits) + F.col("_metadata.row_index")
                return df.select(*columns, number.alias(name))
    return cut(df.select(*columns, F.monotonically_increasing_id().alias(name)))


def row_of(df: DataFrame, row_col: str | None = None):
    """The number of a row: df's own, or a new one. A new one depends on how the scan is split, which
    changes with the cores at hand, so it holds for one scan only and is to be written."""
    return F.monotonically_increasing_id() if row_col is None else column(df, row_col, "bigint")


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2^64, and of its inverse."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            made = np.full(size, base, np.uint64)
            made[0] = 1
            _POWERS[k] = np.multiply.accumulate(made)
    if n <= 1 << 22:
        return _POWERS[0][:n], _POWERS[1][:n]
    found = _POWERS[0][:n], _POWERS[1][:n]
    _POWERS[0], _POWERS[1] = found[0][: 1 << 22].copy(), found[1][: 1 << 22].copy()
    return found


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every span; equal spans have equal hashes."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
#: Odd multipliers of the independent hashes of words and of sequences of words.
_SEEDS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end], for spans in order that do not overlap. Every byte is scrambled
    with its place in the word before it is added, so no arrangement of bytes cancels out. Hashes of
    another seed are independent."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    places = ragged(np.zeros(len(starts), np.int64), lengths).astype(np.uint64)
    values = data if len(places) == len(data) else data[ragged(starts, lengths)]
    each = mix(((places << np.uint64(8)) + values + np.uint64(1)) * _SEEDS[seed])
    return mix(np.add.reduceat(each, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def sequence_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of n words, from their hashes, scrambled word by word."""
    count = max(0, len(words) - n + 1)
    found = np.full(count, n, np.uint64)
    for k in range(n):
        found = mix(found * _SEEDS[seed] + words[k : k + count])
    return found


class Texts:
    """A slice of texts: their UTF-8 bytes in one array, with the offsets of each text."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]
        self.offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, fold: bool = False, seeds: tuple[int, ...] = (0,), space: np.ndarray = SPACE) -> None:
        """Find the words: ``starts`` and ``ends`` in bytes, ``first`` (each text's first word, and
        the end), ``hashes`` and, for further seeds, ``more``. fold: A-Z count as a-z. space: which
        bytes end a word."""
        n = len(self.data)
        solid = ~space[self.data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[inner] = False
        after[inner - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        data = self.data
        if fold:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.hashes, *self.more = (word_hashes(data, self.starts, self.ends, seed) for seed in seeds)

    def byte_values(self) -> np.ndarray:
        return _BYTES[self.data]

    def pieces(self, space: np.ndarray = SPACE, size: int = 4 * SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
        """The same texts in parts of about ``size`` bytes, each with the number of its first text. A
        longer text is cut before a byte that ends a word, so that no word is cut."""
        cuts, at = [0], 0
        while at < len(self.data):
            to = int(self.offsets[np.searchsorted(self.offsets, at + size, "right") - 1])
            while to <= at:
                look = at + size
                while look < len(self.data) and to <= at:
                    found = np.flatnonzero(space[self.data[look : look + size]])
                    to = look + int(found[0]) if len(found) else at
                    look += size
                end = int(self.offsets[np.searchsorted(self.offsets, at, "right")])
                to = min(to, end) if to > at else end
            at = to
            cuts.append(at)
        for a, b in zip(cuts, cuts[1:]):
            first, last = int(np.searchsorted(self.offsets, a, "right")) - 1, int(np.searchsorted(self.offsets, b, "left"))
            part = Texts.__new__(Texts)
            part.data, part.offsets = self.data[a:b], np.clip(self.offsets[first : last + 1], a, b) - a
            yield first, part


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Arrow batches in slices of about ``size`` bytes of text (one row at least), each with its texts."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            part = batch.slice(at, to - at)
            yield part, Texts(part.column(text))
            at = to
        # a worker goes on to the next task and the next operator: what it had must not stay with it
        pa.default_memory_pool().release_unused()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the given lengths, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(begin - starts, lengths)


def long_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow array of lists of 64-bit integers."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64)))
