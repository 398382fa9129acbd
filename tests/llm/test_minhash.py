import random

from test_pipeline import shingles

from turnloom.llm import minhash
from turnloom.llm.components import components, merged

SCHEMA = "doc_id long, text string, node long, bucket string, row int"


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(b)] = find(a)
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    best: dict = {}
    for i in range(len(rows)):
        r = find(i)
        best[r] = min(best.get(r, i), i, key=key)
    return sorted(((rows[i][0], len(sets[i]), rows[best[find(i)]][0]) for i in range(len(rows))), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    got = minhash.near_dedup(df).collect()
    kept: dict = {}
    for r in got:
        kept[r.component_id] = kept.get(r.component_id, 0) + r.kept
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str), kept


def chains(seed, n):
    """Groups of copies with a few edits each, some around the threshold, some chained."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(10**6)
    rows = []
    for g in range(8):
        words = [word() for _ in range(rng.choice([30, 60, 120]))]
        for k in range(n // 8):
            if g % 2:  # a chain: each is edited from the one before
                words = words[:]
                words[rng.randrange(len(words))] = word()
                made = words
            else:
                made = words[:]
                for _ in range(rng.randrange(6)):
                    made[rng.randrange(len(made))] = word()
            text = " ".join(made)
            rows.append((len(rows), text.upper() if k % 5 == 0 else text))
    rng.shuffle(rows)
    return rows


def test_components_against_brute_force(spark):
    rows = chains(3, 240)
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "a"), (None, "null id text of six words"), (None, "null id text of six words"), (1005, "p q r s t u"), (1005, "p q r s t u"), (1006, "w " * 50_000)]
    got, kept = run(spark, rows)
    assert got == brute(rows)
    assert all(n == 1 for c, n in kept.items() if c not in (None,))


def test_a_large_group_and_an_empty_table(spark):
    rng = random.Random(5)
    base = ["v%d" % rng.randrange(10**6) for _ in range(100)]
    rows = []
    for i in range(500):
        made = base[:]
        for _ in range(rng.randrange(1, 5)):
            made[rng.randrange(100)] = "x%d" % rng.randrange(10**6)
        rows.append((i, " ".join(made)))
    got, _ = run(spark, rows)
    assert got == brute(rows)
    assert run(spark, []) == ([], {})


def test_chain_of_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 203), (201, 203), (202, 203)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200, 201: 200, 202: 200, 203: 200}


def test_words_that_cancel_out_in_polynomials(spark):
    """Two words of 1,024 letters that follow the Thue-Morse sequence and its complement share nothing."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))]
    got, kept = run(spark, rows)
    assert got == [(1, 1, 1), (2, 1, 2)] and kept == {1: 1, 2: 1}


def test_further_links_join_components(spark):
    parts = components(spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long"))
    more = spark.createDataFrame([(2, 4), (9, 8), (6, 7)], "a long, b long")
    got = sorted(tuple(r) for r in merged(parts, more).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 5), (8, 8), (9, 8)]


def test_stars_take_one_round(spark, monkeypatch):
    """Links that are components already are looked at once, and no links not at all; each table is counted as it is written."""
    from turnloom.llm import components as module

    written = []
    monkeypatch.setattr(module, "cut", lambda df, write=module.cut: written.append(df) or write(df))
    for links, tables in (([(1, 2), (1, 3), (4, 5)], 2), ([], 1)):
        written.clear()
        got = components(spark.createDataFrame(links, "a long, b long"))
        assert len(written) == tables
        assert all("CollectMetrics" in df._jdf.queryExecution().optimizedPlan().toString() for df in written)
        assert dict(map(tuple, got.collect())) == {x: a for a, b in links for x in (a, b)}


def test_what_no_bucket_needs_is_not_planned(spark, monkeypatch):
    """Where the first links join all of a bucket, nothing is merged and no sets are dealt out to blocks."""
    from turnloom.llm import minhash

    calls = []
    monkeypatch.setattr(minhash, "merged", lambda *a, f=minhash.merged: calls.append("merged") or f(*a))
    text = " ".join(f"w{i}" for i in range(60))
    got, kept = run(spark, [(i, f"{text} end{i}") for i in range(5)] + [(9, "quite another text of six words")])
    assert [(i, c) for i, _, c in got] == [(i, 0) for i in range(5)] + [(9, 9)]
    assert not calls
