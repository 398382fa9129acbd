"""Scores against context-tree weighting done one bit at a time, node by node."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from turnloom.llm import ctw

SCHEMA = "doc_id long, text string, score double, slice string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


class Tree:
    """Every node is updated in sequence; probabilities are products of what it predicted."""

    def __init__(self):
        self.count = defaultdict(lambda: [0, 0])
        self.own = defaultdict(float)  # ln of the node's own estimate of all it has seen

    @staticmethod
    def decisions(text):
        data = bytes([0xFF]) * ctw.DEPTH + text + b"\xff"
        for i in range(ctw.DEPTH, len(data)):
            for bit in range(8):
                yield data[i - ctw.DEPTH : i][::-1], (bit, data[i] >> (8 - bit)), data[i] >> (7 - bit) & 1

    def learn(self, text):
        for context, node, one in self.decisions(text):
            for depth in range(ctw.DEPTH + 1):
                c = self.count[context[:depth], node]
                self.own[context[:depth], node] += math.log((c[one] + 0.5) / (sum(c) + 1))
                c[one] += 1

    def close(self):
        self.children = defaultdict(list)
        for context, node in self.count:
            if context:
                self.children[context[:-1], node].append((context, node))
        self.weighted = {}
        for key in sorted(self.count, key=lambda k: -len(k[0])):
            own = self.own[key]
            below = sum(self.weighted[c] for c in self.children[key])
            self.weighted[key] = own if len(key[0]) == ctw.DEPTH else np.logaddexp(own, below) - math.log(2)

    def ln(self, text):
        total = 0.0
        for context, node, one in self.decisions(text):
            p = 0.0
            for depth in range(ctw.DEPTH, -1, -1):
                key = context[:depth], node
                c = self.count[key] if key in self.count else [0, 0]
                own = (c[one] + 0.5) / (sum(c) + 1)
                stays = 1.0 if depth == ctw.DEPTH else math.exp(self.own[key] - math.log(2) - self.weighted[key]) if key in self.weighted else 0.5
                p = stays * own + (1 - stays) * p
            total += math.log(p)
        return total


def plain(docs):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    tree, counts = Tree(), Counter()
    for i, t, *_ in docs:
        if not held(i):
            tree.learn(low(t))
            counts.update([*WORD.findall(low(t)), None])
    tree.close()
    n, v = sum(counts.values()), len(counts)
    rows = []
    for i, t, *_ in docs:
        tokens = [*WORD.findall(low(t)), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        rows.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, base, tree.ln(low(t)) / math.log(10)))
    return rows


def documents(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "über", "straße", "ж", "x1", "éa"]
    text = lambda: rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 12])))
    docs = [(i, text(), 0.0, "own") for i in range(n)]
    return docs + [docs[0], docs[1], (n, None, None, None), (n + 1, "", None, None), (n + 2, " \n", None, None), (None, "the of", None, None)]


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for k in (5, 6):
        assert np.allclose([r[k] for r in got], [r[k] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("n", [60, 9])
def test_against_plain_version(spark, n):
    docs = documents(n)
    same(ctw.lm_scores(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect(), plain(docs))


def test_nothing_to_learn_from_and_empty(spark):
    df = spark.createDataFrame([(None, "ab", 0.0, ""), (None, None, 0.0, "")], SCHEMA)
    got = {r.n_tokens: r for r in ctw.lm_scores(df).collect()}
    assert got[2].train_tokens == 0 and got[2].base_score == 0
    assert math.isclose(got[2].score, -24 * math.log10(2)) and math.isclose(got[1].score, -8 * math.log10(2))
    assert ctw.lm_scores(df.limit(0)).count() == 0


def test_long_text(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(700_000))
    docs = [(2, long, 0.0, ""), (3, "alpha beta", 0.0, ""), (4, "zzzzq", 0.0, "")]
    got = {r.doc_id: r for r in ctw.lm_scores(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got[2].n_tokens == 700_001 and got[3].n_known == 3
    assert got[2].score / len(long) > got[4].score / 5  # learned, against not learned


def test_probabilities_sum_to_one():
    """Over all bytes after one context, whether the corpus has them or not."""
    tree = Tree()
    for t in (b"abcabc", b"abd", b"the"):
        tree.learn(t)
    runs = Counter()
    for t in (b"abcabc", b"abd", b"the"):
        data = b"\xff" * ctw.DEPTH + t + b"\xff"
        runs.update(data[i - ctw.DEPTH : i][::-1] + data[i : i + 1] for i in range(ctw.DEPTH, len(data)))
    context = b"ba\xff\xff\xff"
    for byte in range(256):
        runs.setdefault(context + bytes([byte]), 0)
    keys = sorted(runs)
    n = np.array([runs[k] for k in keys])
    runs_ = np.array([int.from_bytes(k, "big") for k in keys], np.uint64)
    import pandas as pd
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"key1": pa.array(runs_.view(np.int64)), "n": pa.array(n)})
    rows = pd.concat([b.to_pandas() for b in ctw._roots(iter([batch]))]).groupby(["node", "bit"], as_index=False).sum()

    class Shared:
        value = ctw.Top(rows)

    made = next(iter(ctw._valued(Shared)(iter([batch]))))
    value = dict(zip(keys, made.column("value").to_numpy()))
    assert math.isclose(sum(10 ** value[context + bytes([b])] for b in range(256)), 1, rel_tol=1e-9)


def test_ln_gamma():
    x = np.array([0.5, 1.0, 2.5, 10.0, 1e6])
    assert np.allclose(ctw.ln_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_sums_of_a_slice_are_bounded_by_its_runs(monkeypatch):
    """What a slice is worked on with grows with its distinct runs, not with its length."""
    monkeypatch.setattr(ctw, "CHUNK", 1 << 16)
    monkeypatch.setattr(ctw, "TOGETHER", 1 << 13)
    monkeypatch.setattr(ctw, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(5)
    texts = [rng.choice(np.frombuffer(b"abcd ", np.uint8), 1 << 16).tobytes().decode() for _ in range(64)]
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(64), pa.int64()), "held_out": [i % 4 == 0 for i in range(64)], "text": texts})
    packed = list(ctw._sliced(iter([rows])))
    tracemalloc.start()
    found = [(b.num_rows, int(pc.sum(b.column("n")).as_py())) for b in ctw._asked(iter(packed)) if b.column("key2")[0].as_py() == ctw.RUN]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for _, n in found) == 48 * ((1 << 16) + 1)
    assert max(n for n, _ in found) <= 1 << 13
    assert peak < 24 << 20
