"""Language identification by hierarchical discrimination.

A linear support vector machine per language family first says which family a text is in, one family
against the rest; then machines that each separate two languages of that family vote, one against
one. Features are the byte runs of length one to four within a text, hashed to a fixed number of
weights and taken as shares of all runs, so any length of text counts as a whole. Only text is a feature.

The machines are small and fitted on a bounded sample of labelled texts, drawn by hash of id and text
from all of the table; of those only hashed shares reach the driver, as sparse rows. Prediction is one pass over the
scan: runs are hashed once, weights are looked up and summed per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from turnloom.llm.common import column, named, slices, unused

#: Hashed features (places of 16 bits), and the longest run.
FEATURES, RUNS = 1 << 13, 4
#: Labelled texts per language that the machines are fitted on, about; twice that over all at most.
SAMPLE = 400
UNKNOWN = "und"

#: Families of languages by code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
    "sinitic": ("zh", "yue"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def hashed_runs(data: np.ndarray) -> list[np.ndarray]:
    """For each length the hashed feature of the run that starts at each byte (A-Z lower-cased)."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    found, key = [], np.zeros(len(low), np.uint32)
    for n in range(RUNS):
        key = key[: len(low) - n] * np.uint32(16777619) ^ (low[n:] + np.uint32(1))
        mixed = (key ^ (key >> np.uint32(15))) * np.uint32(2246822519)
        found.append((mixed >> np.uint32(19)).astype(np.int32))
    return found


def _shares(data: np.ndarray) -> np.ndarray:
    """A text's features: for each run length, shares that add to one."""
    total = np.zeros(FEATURES, np.float32)
    for f in hashed_runs(data):
        if len(f):
            total += np.bincount(f, minlength=FEATURES).astype(np.float32) / len(f)
    return total


Rows = list[tuple[np.ndarray, np.ndarray]]


def fit_machine(x: Rows, scale: np.ndarray, rows: np.ndarray, y: np.ndarray, rounds: int = 12, cost: float = 1.0) -> np.ndarray:
    """A linear machine (weights, then bias) for some of the sparse rows (places, values) and their
    labels of -1 and 1: hinge loss by coordinate ascent on the dual, in a fixed order."""
    # both sides weigh the same, however many rows they have
    limit = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost
    alpha, w, bias = np.zeros(len(y)), np.zeros(len(scale), np.float32), 0.0
    square = np.array([float(np.square(x[r][1] * scale[x[r][0]]).sum()) for r in rows]) + 0.01
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            at, value = x[rows[i]]
            value = value * scale[at]
            now = min(max(alpha[i] - (y[i] * (float(w[at] @ value) + bias) - 1) / square[i], 0), limit[i])
            if now != alpha[i]:
                step = (now - alpha[i]) * y[i]
                w[at] += np.float32(step) * value
                bias += step * 0.01
                alpha[i] = now
    return np.append(w, np.float32(bias))


class Model:
    """The fitted machines: one per family, one per pair of languages within a family."""

    def __init__(self, x: Rows, labels: np.ndarray):
        self.langs = sorted(set(labels))
        self.families = sorted({family_of(v) for v in self.langs})
        names = np.array([family_of(v) for v in labels])
        total = np.zeros(FEATURES, np.float64)
        for at, value in x:
            total[at] += value
        # rare and common runs alike: features are scaled by their spread over the sample
        scale = (4 / np.sqrt(total / len(x) + 1e-4)).astype(np.float32)
        self.machines, made = [], []
        if len(self.families) > 1:
            for family in self.families:
                made.append(fit_machine(x, scale, np.arange(len(x)), np.where(names == family, 1, -1)))
                self.machines.append(("family", family, None))
        for family in self.families:
            for a, b in combinations([v for v in self.langs if family_of(v) == family], 2):
                rows = np.flatnonzero((labels == a) | (labels == b))
                made.append(fit_machine(x, scale, rows, np.where(labels[rows] == a, 1, -1)))
                self.machines.append(("pair", a, b))
        weights = np.array(made, np.float32).reshape(len(made), FEATURES + 1)
        self.bias = weights[:, -1].copy()
        self.weights = np.ascontiguousarray(weights[:, :-1] * scale)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Every machine's margin for every text, from all of its runs."""
        lengths = np.diff(offsets)
        out = np.tile(self.bias.astype(np.float64), (len(lengths), 1))
        if not len(self.weights) or not len(data):
            return out
        for n, f in enumerate(hashed_runs(data)):
            count = np.maximum(lengths - n, 0)
            some = np.flatnonzero(count)
            # runs that cross into the next text do not count: sums end before them
            edges = np.stack([offsets[:-1][some], offsets[:-1][some] + count[some]], 1).ravel()
            for k, w in enumerate(self.weights):
                values = np.append(w[f], 0).astype(np.float64)
                out[some, k] += np.add.reduceat(values, edges)[::2] / count[some]
        return out

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores (0 to 1) for rows of margins."""
        langs, scores = [], np.zeros(len(margins))
        at = {m: k for k, m in enumerate(self.machines)}
        chance = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
        for i, row in enumerate(margins):
            family = max(self.families, key=lambda v: (row[at["family", v, None]], v)) if len(self.families) > 1 else self.families[0]
            score = chance(row[at["family", family, None]]) if len(self.families) > 1 else 1.0
            inside = [v for v in self.langs if family_of(v) == family]
            votes = {v: [0, 0.0] for v in inside}
            for a, b in combinations(inside, 2):
                m = row[at["pair", a, b]]
                for lang, won in ((a, m), (b, -m)):
                    votes[lang][0] += won > 0
                    votes[lang][1] += won
            lang = max(inside, key=lambda v: (*votes[v], v))
            if len(inside) > 1:
                score *= chance(votes[lang][1] / (len(inside) - 1))
            langs.append(lang)
            scores[i] = score
        return langs, scores


def fit(df: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model from the rows of df where ``train`` holds and lang and text are not null; None without any.

    Per language about ``sample`` texts are drawn by hash of id and text, and never more than twice
    that over all. The number of languages is what a label column has: a few hundred at most.
    """
    rows = df.filter(F.lit(True) if train is None else train).select(column(df, id_col, "string").alias("id"), column(df, text_col, "string").alias("text"), column(df, lang_col, "string").alias("lang")).filter("text is not null and lang is not null")
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[v for lang, n in counts.items() for v in (F.lit(lang), F.lit(min(1.0, sample / n)))])
    drawn = rows.filter(F.col("draw") < F.element_at(share, F.col("lang"))).select("lang", "draw", F.col("text").cast("binary").alias("body"))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shares(np.frombuffer(b, np.uint8)) for b in batch.column("body").to_pylist()]
            some = [np.flatnonzero(f).astype(np.uint16) for f in found]
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "draw": batch.column("draw"), "at": pa.array([s.tobytes() for s in some], pa.binary()), "value": pa.array([f[s].tobytes() for f, s in zip(found, some)], pa.binary())})

    drawn = drawn.mapInArrow(shares, "lang string, draw double, at binary, value binary").orderBy("draw", "lang", "at", "value").limit(2 * sample * len(counts))
    x: Rows = []
    labels: list[str] = []
    for r in drawn.toLocalIterator():  # sparse: a few kB for each text of a bounded number
        x.append((np.frombuffer(r["at"], np.uint16), np.frombuffer(r["value"], np.float32)))
        labels.append(r["lang"])
    return Model(x, np.array(labels, dtype=object)) if labels else None


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a letter."""
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    sums = np.concatenate([[0], np.cumsum(letter)])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return found


def predict(df: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of df with a predicted language and its score, named by ``names``, which are to
    differ from those in keep.

    Texts that are null, empty or without any letter get ``und`` and score 0, as do all without a model
    (nothing to learn from). Where machines tie, the language that is last by name is taken.
    """
    taken = [df.schema[c] for c in keep]
    rows = df.select(*(named(c) for c in keep), *([] if text_col in keep else [column(df, text_col, "string").alias(text_col)]))
    known = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for part, texts in slices(batches, text_col):
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            some = np.flatnonzero(_has_letter(texts.data, texts.offsets)) if model else []
            if len(some):
                found, score = model.predict(model.margins(texts.data, texts.offsets)[some])
                for i, lang in zip(some, found):
                    langs[i] = lang
                scores[some] = score
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(langs), pa.array(scores)], names=[*keep, *names])

    return rows.mapInArrow(run, StructType([*taken, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def keep_known(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of df that get a language, with all their columns, whatever their names."""
    names = (unused(df, "lang_pred"), unused(df, "score"))
    return predict(df, model, df.columns, text_col, names).filter(named(names[0]) != UNKNOWN).select(*(named(c) for c in df.columns))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no machine learns from: a checksum of the id, modulo 4, is 2. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of df: ``doc_id, held_out, lang_pred, score``. Learns from the rows that are not
    held out and have a lang; lang and ids are no input of a prediction.

    Null, empty and letterless texts are ``und``, with score 0; so are all where nothing can be learned.
    Texts of any length count as a whole. Null ids are held out; repeated rows each get the same
    language. Ties go to the language that is last by name. An empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    model = fit(df, ~held_out(id_col), id_col, text_col, lang_col)
    rows = df.select(column(df, id_col, "bigint").alias("doc_id"), held_out(id_col).alias("held_out"), column(df, text_col, "string").alias("text"))
    return predict(rows, model, ["doc_id", "held_out"])
