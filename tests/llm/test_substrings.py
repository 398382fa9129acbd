import hashlib
import random

import pytest

from turnloom.llm import rlz, suffix

SCHEMA = "doc_id long, text string, row string, place int, ord string"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def gone_units(rows, split):
    """Brute force: for every row, which of its units are covered by a run that an earlier id has too."""
    key = lambda i: 2**63 - 1 if i is None else i
    low: dict = {}
    for i, t in rows:
        u = split(t)
        for p in range(len(u) - 49):
            k = tuple(u[p : p + 50])
            low[k] = min(low.get(k, 2**63), key(i))
    for i, t in rows:
        u, gone = split(t), set()
        for p in range(len(u) - 49):
            if low[tuple(u[p : p + 50])] < key(i):
                gone.update(range(p, p + 50))
        yield i, u, gone


def brute_words(rows):
    split = lambda t: (t or "").encode().split()
    return sorted(((i, len(u), len(g), sha(b" ".join(w for n, w in enumerate(u) if n not in g))) for i, u, g in gone_units(rows, split)), key=str)


def brute_bytes(rows):
    split = lambda t: (t or "").encode()
    return sorted(((i, len(u), len(g), sum(n - 1 not in g for n in g), sha(bytes(b for n, b in enumerate(u) if n not in g))) for i, u, g in gone_units(rows, split)), key=str)


def words(df):
    return rlz.substring_dedup(df).drop("n_factors")


def run(spark, op, rows):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).coalesce(1)
    return sorted((tuple(r) for r in op(df).collect()), key=str)


def passages(seed, unit, n):
    """Texts stitched from shared passages of many lengths, around and above the threshold."""
    rng = random.Random(seed)
    piece = lambda k: [unit(rng) for _ in range(k)]
    shared = [piece(rng.choice([20, 49, 50, 51, 60, 75, 120])) for _ in range(12)]
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(shared)
            if rng.random() < 0.4:
                a = rng.randrange(len(p))
                p = p[a:]
            if rng.random() < 0.2:
                p = p[:]
                p[rng.randrange(len(p))] = unit(rng)
            parts += p + (piece(rng.randrange(30)) if rng.random() < 0.6 else [])
        yield i, parts


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_brute_force(spark, seed):
    word = lambda rng: "".join(rng.choice("abAé") for _ in range(2))
    rows = [(i * 7 % 120, " ".join(p).replace("aa ", "aa\n\t")) for i, p in passages(seed, word, 120)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "x " * 400), (204, "x " * 60), (None, "x " * 55), (None, "y " * 55), (None, "y " * 55), (205, "same " * 60), (205, "same " * 60)]
    assert run(spark, words, rows) == brute_words(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_against_brute_force(spark, seed):
    char = lambda rng: rng.choice("abcé \n")
    rows = [(i * 7 % 120, "".join(p)) for i, p in passages(seed, char, 120)]
    rows += [(200, None), (201, ""), (202, "x"), (203, "x" * 400), (204, "x" * 60), (None, "x" * 55), (None, "y" * 55), (205, "zw" * 60), (205, "zw" * 60), (206, "é" * 70), (207, "é" * 30)]
    assert run(spark, suffix.suffix_dedup, rows) == brute_bytes(rows)
    if seed == 1:
        assert run(spark, suffix.doubled, rows) == brute_bytes(rows)


def test_empty_tables(spark):
    assert run(spark, words, []) == [] == run(spark, suffix.suffix_dedup, []) == run(spark, suffix.doubled, [])
    assert run(spark, words, [(1, None)]) == [(1, 0, 0, sha(b""))]


def test_large_texts(spark, monkeypatch):
    rng = random.Random(9)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(60_000))
    rows = [(1, text), (2, "start " + text), (3, text[1000:2000])]
    got = {r[0]: r for r in run(spark, suffix.suffix_dedup, rows)}
    assert got[1][2] == 0 and got[2][2] == len(text) and got[3][2] == 1000


@pytest.mark.parametrize("held", [1, 7, 40])
def test_anchors_of_one_gram_in_many_batches(monkeypatch, held):
    """Whatever a task holds at a time, no anchor that another row shares is dropped."""
    import numpy as np
    import pyarrow as pa

    from turnloom.llm import sampling

    monkeypatch.setattr(sampling, "HELD", held)
    rng = random.Random(held)
    rows = sorted((rng.choice([1, 2, 2, 2, 3, 4, 5, 6, 7]), rng.randrange(3) << 16 | rng.randrange(3), rng.randrange(6)) for _ in range(60))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c, t)) for c, t in zip((*zip(*rows[i : i + 4]), [0] * len(rows[i : i + 4])), ("i8", "i4", "i8", "i4"))], names=["gram", "sides", "row", "near"]) for i in range(0, 60, 4)]
    near = {tuple(r.values())[:3]: r["near"] for b in sampling._shared(iter(batches)) for r in b.to_pylist()}
    got = list(near)
    others = lambda r, bit: any(r[0] == o[0] and r[2] != o[2] and (r[1] >> 16 == o[1] >> 16 if bit == 1 else r[1] & 0xFFFF == o[1] & 0xFFFF) for o in rows)
    assert all(near[r] & bit for r in got for bit in (1, 2) if others(r, bit))
    need = {r for r in rows for o in rows if r[0] == o[0] and r[2] != o[2] and (r[1] >> 16 == o[1] >> 16 or r[1] & 0xFFFF == o[1] & 0xFFFF)}
    assert need <= set(got) <= set(rows) and (held < 60 or set(got) == need)
    whole = list(sampling._shared(iter([pa.concat_batches(batches)]))) if held == 40 else []
    assert held != 40 or whole


def test_changes_that_a_weak_fingerprint_misses(spark):
    """Bytes that differ by 0x40 and 0x80 in several places of 16."""
    rows = [(1, "q v!fye!  kjdwqa tje ger xbyk  tzv r  xwgfjnrfbw v"), (2, "q vafyea  kjdwq! tje ger xbyk  tzv r  xwgfjnrfbw v")]
    assert run(spark, suffix.suffix_dedup, rows) == brute_bytes(rows)
    for seed, pairs in enumerate(["!a", "-m", "0p", "é)", "!a-m0p"]):
        rng = random.Random(seed)
        rows = []
        for _ in range(12):
            text = [rng.choice("abcdefgh ") for _ in range(70)]
            places = rng.sample(range(70), 24)
            for k in range(6):
                for p in places:
                    text[p] = rng.choice(pairs)
                rows.append((len(rows), "".join(text)))
        assert run(spark, suffix.suffix_dedup, rows) == brute_bytes(rows)


def test_names_tell_all_small_changes_apart():
    import numpy as np
    import pyarrow as pa

    from turnloom.llm.common import Texts
    from turnloom.llm.sampling import LENGTH, Units

    rng = random.Random(5)
    text = [rng.choice("abcdefgh !") for _ in range(LENGTH)]
    texts = {"".join(text)}
    while len(texts) < 20_000:
        made = list(text)
        for p in rng.sample(range(LENGTH), rng.choice([1, 2, 3, 4])):
            made[p] = chr(ord(made[p]) ^ rng.choice([0x40, 0x20, 0x10, 0x08]))
        texts.add("".join(made))
    u = Units.of_bytes(Texts(pa.array(sorted(texts))))
    for kind in (0, 1):
        assert len(np.unique(u.at(u.first, LENGTH, kind))) == len(texts)
