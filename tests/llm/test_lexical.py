"""Ranked search against a plain version."""

import math
import random
import re

import pytest

from turnloom.llm import lexical

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score string, item int"


def terms(text):
    return TERM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def plain(docs, queries, k):
    bags = [(i, terms(t)) for i, t, *_ in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(len(b) for _, b in bags)
    found = []
    wanted = {}
    for i, t in queries:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    df = {t: sum(t in b for _, b in bags) for ts in wanted.values() for t in ts}
    for item, ts in wanted.items():
        scored = []
        for i, b in bags:
            m = 100 - 90 + (90 * len(b) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b.count(t)) // (1000 * b.count(t) + 8 * m)) for t in ts if t in b)
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        found += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(found)


def tables(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "straße", "ж", "x1", "42", " ", "a_b", "naïve", *(f"w{i}" for i in range(40))]
    text = lambda n: rng.choice([" ", "-", "\n", "_"]).join(rng.choice(words[: rng.choice([5, len(words)])]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 60])), "x", 1) for i in rng.sample(range(1000), 120)]
    docs += [docs[0]] * 30 + [(None, docs[1][1], None, None), (2000, None, "", 0), (2001, " -_- ", "", 0), (2002, "the " * 5000 + "rare", "", 0)]
    queries = [(i, text(rng.choice([1, 4, 30]))) for i in range(25)] + [(3, "rare"), (None, "the"), (90, None), (91, "unknownterm"), (92, "")]
    return docs, queries


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("seed, k, block", [(1, 10, 1 << 20), (2, 3, 40)])
def test_against_plain_version(spark, monkeypatch, seed, k, block):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    docs, queries = tables(seed)
    got = lexical.ranked_search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(queries, "item_id long, text string"), k)
    assert found(got) == plain(docs, queries, k)


def test_several_shards_of_a_task_and_pieces_of_a_text(monkeypatch):
    """In one process, with shards of a few documents and pieces of a few bytes."""
    import numpy as np
    import pyarrow as pa

    from turnloom.llm.common import Texts

    docs, _ = tables(5)
    whole = Texts(pa.array([t for _, t, *_ in docs]))
    want = [terms(t) for _, t, *_ in docs]
    for size in (1, 7, 64):
        have = [0] * len(docs)
        for first, piece in whole.pieces(lexical.APART, size):
            piece.words(fold=True, space=lexical.APART)
            for k, n in enumerate(np.diff(piece.first)):
                have[first + k] += int(n)
        assert have == [len(w) for w in want]


def test_ties_and_selection():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = rng.integers(-1, 4, rng.integers(0, 30))
        want = sorted((-s, i) for i, s in enumerate(scores) if s > 0)[:5]
        assert sorted((-scores[i], i) for i in lexical.best(scores, 5)) == want


def test_empty_tables(spark):
    docs, queries = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.ranked_search(docs, queries).count() == 0
    assert lexical.ranked_search(spark.createDataFrame([(1, "the", "", 0)], DOCS), queries.limit(0)).count() == 0
    assert lexical.ranked_search(spark.createDataFrame([(1, None, "", 0)], DOCS), queries).count() == 0
