"""Where runs of a fixed length could repeat: names of runs by doubling, and sampled positions.

Units are words or bytes. A run of 2h units is named by the pair of the names of its halves, so names of
any length come from a few steps; they are 64-bit fingerprints, of two kinds that are independent from
the units up: units are scrambled with a seed of the kind before they are paired.

A run of LENGTH units is sampled by its minimizer: of the grams in it the one with the smallest name.
Equal runs have it at the same place, so two equal runs always meet at an equal sampled gram, an anchor,
and only one position in about 18 is one. Spark sorts the anchors by gram; those that have neither what
stands left of the gram nor what stands right of it in common with another row drop out: nearly all do.

Grams that very many rows hold do not fill one task: rows that a task has seen twice before are known to
be shared, and are dealt out at random.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import Texts, column, cut, mix, ragged, slices, with_rows

LENGTH, GRAM = 50, 16
#: Units of a side, of which every run that holds the gram has the left one or the right one whole.
SIDE = (LENGTH - GRAM) // 2
#: What stands between two texts, in units: more than any look beyond their ends.
GAP = 64
#: Anchors that a task holds to compare, about.
HELD = 200_000
#: A gram with more than one in so many anchors is dealt out by its surroundings.
HOT_SHARE = 1000
#: Null ids count as larger than any id.
LAST = 2**63 - 1

_TIMES = np.array([[0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xE7037ED1A0B428DB]], np.uint64)
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)


def pair(left: np.ndarray, right: np.ndarray, kind: int = 0) -> np.ndarray:
    """The names of pairs of names. Each side is scrambled by itself and the left one turned before they
    meet, so that no change of one side makes up for a like change of the other."""
    made = left * _TIMES[kind, 0]
    made ^= made >> np.uint64(32)
    made = made << np.uint64(23) | made >> np.uint64(41)
    other = right * _TIMES[kind, 1]
    other ^= other >> np.uint64(29)
    made += other
    made *= _TIMES[kind, 2]
    made ^= made >> np.uint64(32)
    return made


class Units:
    """The units of a slice's texts in one array, apart from each other by gaps of zeros."""

    def __init__(self, base: list[np.ndarray], width: int, first: np.ndarray, counts: np.ndarray):
        """base: of each kind, values of the runs of ``width`` units that start at each place, equal for
        equal runs only or hashed independently; first, counts: of texts."""
        self.base, self.width, self.first, self.counts = base, width, first, counts
        grams, h = mix(base[0] ^ _SEEDS[0]), width
        while h < GRAM:
            grams, h = pair(grams[:-h], grams[h:]), 2 * h
        self.grams = grams

    @classmethod
    def of_bytes(cls, texts: Texts) -> Units:
        counts = np.diff(texts.offsets)
        first = GAP + np.cumsum(counts + GAP) - (counts + GAP)
        gap = bytes(GAP)
        data = gap + b"".join([p for i in range(len(texts)) for p in (texts.text(i), gap)]) + gap
        eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
        return cls([eights, eights], 8, first, counts)

    @classmethod
    def of_words(cls, texts: Texts) -> Units:
        texts.words(seeds=(0, 1))
        counts = np.diff(texts.first)
        first = GAP + np.cumsum(counts + GAP) - (counts + GAP)
        values, at = np.zeros((2, int(counts.sum()) + GAP * (len(counts) + 2)), np.uint64), ragged(first, counts)
        values[0, at], values[1, at] = texts.hashes, texts.more[0]
        return cls(list(values), 1, first, counts)

    def at(self, places: np.ndarray, length: int, kind: int = 0) -> np.ndarray:
        """The names of the runs of that length, GAP at most, that start at the places."""
        if length == self.width:
            return mix(self.base[kind][places] ^ _SEEDS[kind])
        if length == GRAM and kind == 0:
            return self.grams[places]
        half = 1 << (length - 1).bit_length() - 1
        return pair(self.at(places, half, kind), self.at(places + (length - half), half, kind), kind)

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """The starts of all runs of LENGTH units within a text, and the places of their minimizers,
        leftmost where equal."""
        long = self.counts >= LENGTH
        starts = ragged(self.first[long], self.counts[long] - LENGTH + 1)
        if not len(starts):
            return starts, starts
        low = self.grams >> np.uint64(32)
        low <<= np.uint64(32)
        low |= np.arange(len(low), dtype=np.uint64)
        span, wide = 1, LENGTH - GRAM + 1
        while 2 * span <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        return starts, (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places, texts, grams and sides (16 bits each) of the anchors of all texts."""
        _, places = self.minimizers()
        if len(places):
            places = places[np.concatenate([[True], places[1:] != places[:-1]])]
        low = np.uint64(0xFFFF)
        sides = (self.at(places - SIDE, SIDE) & low) << np.uint64(16) | self.at(places + GRAM, SIDE) & low
        return places, self.text_of(places), self.grams[places], sides.astype(np.uint32).view(np.int32)


def numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, ord, text`` of df, with numbers that all scans agree on."""
    doc_id = column(df, id_col, "bigint")
    return with_rows(df, "row", [doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("ord"), F.coalesce(column(df, text_col, "string"), F.lit("")).alias("text")])


def _wide(sides: np.ndarray) -> np.ndarray:
    return sides.view(np.uint32).astype(np.uint64)


def _anchor_key(grams: np.ndarray, sides: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(grams + mix(_wide(sides)) + mix(text.astype(np.uint64) + np.uint64(1)))


def _anchors(units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            _, text, grams, sides = units(texts).anchors()
            # a gram that repeats with the same sides within a text counts once
            _, one = np.unique(_anchor_key(grams, sides, text), return_index=True)
            text, grams, sides = text[one], grams[one], sides[one]
            # of one that is in several texts two rows tell the others; the rest is shared for sure
            order = np.lexsort((sides, grams))
            same = np.concatenate([[False], (grams[order][1:] == grams[order][:-1]) & (sides[order][1:] == sides[order][:-1])]) if len(order) else np.zeros(0, bool)
            sure = np.zeros(len(order), bool)
            sure[order] = same & np.concatenate([[False], same[:-1]]) if len(order) else same
            yield pa.RecordBatch.from_pydict({"gram": pa.array(grams.view(np.int64)), "sides": pa.array(sides), "row": part.column("row").take(pa.array(text)), "near": pa.array(np.where(sure, 3, 0).astype(np.int32))})

    return run


def _in_other_rows(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which keys are in more than one row."""
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = np.minimum.reduceat(row, start) != np.maximum.reduceat(row, start)
    found = np.empty(len(key), bool)
    found[order] = np.repeat(several, np.diff(np.append(start, len(key))))
    return found


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by gram those that have a side in common with another row's; ``near`` is 1 where
    it is the left side, 2 the right, 3 both.

    Whole runs of a gram are looked at together, a few at a time. A run too long to hold passes as it
    is: what follows decides exactly, and only has more to look at.
    """
    held: list[pa.RecordBatch] = []
    count, passing = 0, None

    def judged(part: pa.RecordBatch) -> pa.RecordBatch:
        gram, sides, row, near = (part.column(name).to_numpy() for name in ("gram", "sides", "row", "near"))
        same = gram[1:] == gram[:-1]
        some = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        near = near.copy()
        if len(some):
            base, side = mix(gram[some].view(np.uint64)), _wide(sides[some])
            left, right = mix(base + (side >> np.uint64(16))), mix(base + (side & np.uint64(0xFFFF)) + np.uint64(1 << 20))
            near[some] |= _in_other_rows(left, row[some]) + 2 * _in_other_rows(right, row[some]).astype(np.int32)
        return with_near(part, near).take(pa.array(np.flatnonzero(near)))

    def with_near(part: pa.RecordBatch, near: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(part.column(n) for n in ("gram", "sides", "row")), pa.array(near.astype(np.int32))], names=["gram", "sides", "row", "near"])

    def passed(part: pa.RecordBatch) -> pa.RecordBatch:
        return with_near(part, np.full(part.num_rows, 3))

    def together() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if passing is not None and batch.num_rows:
            gram = batch.column("gram").to_numpy()
            same = int(np.argmin(gram == passing)) if gram[-1] != passing else len(gram)
            if same:
                yield passed(batch.slice(0, same))
            if same == len(gram):
                continue
            batch, passing = batch.slice(same), None
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < HELD:
            continue
        whole = together()
        gram = whole.column("gram").to_numpy()
        end = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if gram[0] != gram[-1] else 0
        if end:
            yield judged(whole.slice(0, end))
        rest = whole.slice(end)
        held, count = [rest], rest.num_rows
        if count >= HELD:
            yield passed(rest)
            held, count, passing = [], 0, gram[-1]
    if held:
        yield judged(together())


def candidates(rows: DataFrame, units) -> DataFrame:
    """``row, anchors`` (gram, sides, near): of each row (row, text) the anchors that another row shares."""
    found = rows.select("row", "text").mapInArrow(_anchors(units), "gram long, sides int, row long, near int")
    dealt = found.repartition(F.when(F.col("near") == 3, F.xxhash64("gram", "row")).otherwise(F.col("gram")))
    shared = dealt.sortWithinPartitions("gram").mapInArrow(_shared, "gram long, sides int, row long, near int")
    return cut(shared.groupBy("row").agg(F.collect_list(F.struct("gram", "sides", "near")).alias("anchors")))


def hot_grams(lists: DataFrame) -> np.ndarray:
    """The grams that more than one in HOT_SHARE of the shared anchors have: so many of them at most."""
    total = lists.agg(F.sum(F.size("anchors"))).first()[0] or 0
    counts = lists.select(F.explode("anchors.gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    found = counts.filter(F.col("n") > max(HOT_SHARE, total // HOT_SHARE)).select("gram").collect()
    return np.array(sorted(r.gram for r in found), np.int64).view(np.uint64)


def wanted(part: pa.RecordBatch, u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, texts, grams and ``near`` of the listed anchors of a part's texts."""
    places, text, grams, sides = u.anchors()
    lists = part.column("anchors")
    counts = lists.value_lengths().fill_null(0).to_numpy()
    listed = lists.flatten()
    keys = _anchor_key(listed.field("gram").to_numpy().view(np.uint64), listed.field("sides").to_numpy(), np.repeat(np.arange(len(counts)), counts))
    if not len(keys) or not len(places):
        return places[:0], text[:0], grams[:0], np.zeros(0, np.int32)
    order = np.argsort(keys)
    key = _anchor_key(grams, sides, text)
    at = order[np.minimum(np.searchsorted(keys, key, sorter=order), len(keys) - 1)]
    chosen = keys[at] == key
    return places[chosen], text[chosen], grams[chosen], listed.field("near").to_numpy()[at[chosen]]


def later(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Which rows have an equal key in a row of smaller order here."""
    if not len(order):
        return np.zeros(0, bool)
    sort = np.lexsort((order, *keys))
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[sort][1:] != k[sort][:-1]
    start = np.flatnonzero(new)
    least = np.repeat(order[sort][start], np.diff(np.append(start, len(order))))
    found = np.zeros(len(order), bool)
    found[sort] = order[sort] > least
    return found


def apart(row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys that deal rows out evenly, each on its own."""
    return mix(mix(row.view(np.uint64)) + place.astype(np.uint64))


def covered(spans: pa.Array, first: np.ndarray, total: int) -> np.ndarray:
    """Of all units, which ones the spans (begin, end) listed for each text cover. first: of the texts."""
    counts = spans.value_lengths().fill_null(0).to_numpy()
    flat = spans.flatten()
    base = np.repeat(first[: len(counts)], counts)
    depth = np.zeros(total + 1, np.int32)
    np.add.at(depth, flat.field("begin").to_numpy() + base, 1)
    np.add.at(depth, flat.field("end").to_numpy() + base, -1)
    return np.cumsum(depth[:-1]) > 0
