import random
import re

import pytest

from turnloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, place int"


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, s, 1, 1) for i, t, s in rows], SCHEMA)
    return sorted((tuple(r) for r in mixing.mix_sources(df, **more).drop("row").collect()), key=str)


def targets(sizes, weights, share, most):
    """Water filling, round by round. Null last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, found = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return found | {s: level * weight[s] for s in open_}
        for s in over:
            found[s] = most * sizes[s]
            left -= found[s]
            open_.remove(s)
    return found


@pytest.mark.parametrize("limit", [20_000, 0])
def test_targets_and_words_taken(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    rng = random.Random(4)
    names = ["b", "a", None, "é", "z", ""]
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 30, 200])), rng.choice(names + ["a"] * 6)) for i in range(600)]
    rows += [(None, "x y", "a"), (5, "", "a"), (6, None, "b"), (7, " \t\n", "none"), (8, "x y", "z"), (8, "x y", "z")]
    got = run(spark, rows)
    assert got == run(spark, rows[::-1])
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes, (3, 1, 2), 1.5, 2)
    taken: dict = {}
    for _, s, size, source_size, target, copies, words in got:
        assert source_size == sizes[s] and abs(target - want[s]) < 1e-6 * max(1, target)
        assert words == copies * size <= 2 * size
        taken[s] = taken.get(s, 0) + words
    assert len(got) == len(rows)
    for s, target in want.items():
        assert target - 40 <= taken[s] <= target + 1e-6


def test_empty_and_sizeless(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, "a"), (2, "", None)]) == [(1, "a", 0, 0, 0.0, 0, 0), (2, None, 0, 0, 0.0, 0, 0)]


def test_what_a_pass_joins_is_written_once(spark, monkeypatch):
    """No plan of a pass holds its joins twice, for the edge and for the others."""
    plans = []
    monkeypatch.setattr(mixing, "cut", lambda df, write=mixing.cut: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    mixing.mix_sources(spark.createDataFrame([(i, "word " * (i % 7), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string"))
    assert max(p.count("Join ") for p in plans) <= 4
