import math
import random

import pytest
from pyspark.sql import functions as F

from turnloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, terms int"


def brute(rows, k, asked=lambda i: i % 20 == 0):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for i, q in good:
        if asked(i):
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i)
            found += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(found)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("blocks", [(4096, 4096), (7, 3)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, rng.uniform(-1, 1)]) for _ in range(8)], "x", 1) for i in range(90)]
    rows += [(100 + i, [0.5] * 8, None, None) for i in range(40)]  # ties
    rows += [(200, None, "x", 1), (201, [1.0, None], "x", 1), (220, [float("nan")] * 8, "x", 1), (240, [float("inf")] * 8, "x", 1), (None, [1.0] * 8, "x", 1)]
    got = topk.exact_top_k(spark.createDataFrame(rows, SCHEMA), k=5)
    assert rows_of(got) == brute(rows, 5)


def test_few_candidates_empty_and_unequal_lengths(spark):
    rows = [(0, [1.0, 2.0], "", 0), (1, [1.0], "", 0), (2, [], "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(topk.exact_top_k(df)) == [(0, 1, 1, 4096), (0, 2, 2, 0)]
    assert topk.exact_top_k(df.limit(0)).count() == 0
    assert topk.exact_top_k(df.filter("vec_id > 0")).count() == 0


def test_sparse_and_large_weights(spark):
    rows = [(i, [float(i == j) * 1e6 for j in range(30)], "", 0) for i in range(30)] + [(40, [1e6] * 30, "", 0)]
    got = topk.exact_top_k(spark.createDataFrame(rows, SCHEMA), k=4, is_query=F.col("vec_id") >= 28)
    assert rows_of(got) == brute(rows, 4, lambda i: i >= 28)


def test_scores_of_many_digits_in_a_full_block(spark):
    """The best of 4,096 candidates is the last one; its score times the block's size passes 64 bits."""
    rows = [(i, [1.28e6 if i in (0, 4095) else 1e3 * i / 4096], "", 0) for i in range(4097)]
    got = topk.exact_top_k(spark.createDataFrame(rows, SCHEMA), k=3, is_query=F.col("vec_id") == 0)
    assert rows_of(got) == brute(rows, 3, lambda i: i == 0)
