"""The manifest against a plain version, small blocks included."""

import hashlib
import random
import zlib

import pytest

from turnloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc[0], doc[3], doc[2], doc[4], doc[1])))


def levels_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, at):
    found = []
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        found.append((run[: at % 16], run[at % 16 + 1 :]))
        at //= 16
    return found


def plain(docs, odd):
    names = sorted({d[3] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((d for d in docs if d[3] == s), key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d))) for s in names}
    trees = {s: levels_of([leaf_of(d) for d in own[s]]) for s in names}
    over = levels_of([trees[s][-1][0] for s in names])
    root, rows = over[-1][0], []
    for k, s in enumerate(names):
        for at, d in enumerate(own[s]):
            steps = path(trees[s], at) + path(over, k)
            value = leaf_of((d[0], d[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in d[1]), *d[2:])) if odd(d[0]) else leaf_of(d)
            for left, right in steps:
                value = h(*left, value, *right)
            rows.append((d[0], leaf_of(d), trees[s][-1][0], root, h(*(x for left, right in steps for x in left + right)), value, value == root))
    return sorted(rows, key=str)


def fifth(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def documents(n, sources):
    rng = random.Random(n)
    texts = ["Ünïcode Ä", "plain", "ABC def", "", None, "line\nline", "x" * 70_000 + "Z"]
    docs = [(i, rng.choice(texts), rng.choice(["en", None]), rng.choice(sources), rng.choice([None, 3, -1]), "own leaf", i) for i in rng.sample(range(10 * n), n)]
    return docs + docs[:3] + [(None, "Null id", "en", sources[0], 1, None, None)] * 2


@pytest.mark.parametrize("n, sources", [(1, ["a"]), (16, ["a"]), (17, [None]), (600, ["a", "b", "é", "\U0001f600", "￿", None, "B"]), (300, [f"s{i}" for i in range(280)])])
def test_against_plain_version(spark, n, sources):
    docs = documents(n, sources)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = merkle.manifest(df, tampered=merkle.every_fifth())
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, fifth)


def test_rounds_beyond_one_block(spark):
    """More than 4,096 leaves of a source: its frontier is shuffled again."""
    docs = [(i, f"T{i}", "en", "hot" if i % 3 else "cold", i) for i in range(9000)]
    got = merkle.manifest(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), tampered=merkle.every_fifth())
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == plain(docs, fifth)
    assert {r[6] for r in found} == {True, False}


def test_merging_partial_parents_in_any_order():
    for seed in range(20):
        rng = random.Random(seed)
        n = rng.choice([1, 15, 16, 17, 300, 4096, 4000])
        leaves = [h(str(i)) for i in range(n)]
        parts = [merkle.Block(n) for _ in range(rng.choice([1, 2, 5]))]
        for i in rng.sample(range(n), n):
            rng.choice(parts).leaf((i, leaves[i], i, None))
        rng.shuffle(parts)
        whole = parts[0]
        for other in parts[1:]:
            whole = whole.merge(other)
        assert [[v[k] for k in sorted(v)] for v in whole.nodes if v] == levels_of(leaves)
        assert sorted(whole.rows) == list(range(n))


def test_empty_and_untouched(spark):
    df = spark.createDataFrame(documents(5, ["a"]), SCHEMA)
    assert merkle.manifest(df.limit(0)).count() == 0
    assert all(r.verified for r in merkle.manifest(df).collect())
