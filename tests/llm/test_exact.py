import hashlib
import random

from turnloom.llm import exact

SCHEMA = "doc_id long, text string, name long, level int, row string"


def brute(rows):
    groups: dict = {}
    for i, text, *_ in rows:
        groups.setdefault(text or "", []).append(i)
    key = lambda i: (i is not None, i or 0)
    found = []
    for text, ids in groups.items():
        best = max(ids, key=key)
        for n, i in enumerate(sorted(ids, key=key, reverse=True)):
            found.append((i, best, len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(found, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 7, 8, "x") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in exact.exact_dedup(df, **more).drop("row").collect()), key=str)


def test_texts_of_all_lengths(spark):
    rng = random.Random(2)
    texts = ["", None, "a", "ab", "é", "b" * 8, "b" * 9, "b" * 16, "b" * 17, "ab" * 40, "ab" * 40 + "c", "x" * 5000, "x" * 5000 + "y"]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    rows = [(i, rng.choice(texts)) for i in range(900)] + [(None, "a"), (None, "only"), (3, "twice"), (3, "twice"), (3, "twice")]
    assert run(spark, rows, block_bytes=4) == brute(rows)


def test_hot_values_are_named_apart(spark, monkeypatch):
    rows = [(i, "same " * 30) for i in range(1500)] + [(2000 + i, f"other {i % 40} " * 9) for i in range(200)]
    assert run(spark, rows, block_bytes=16) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_rows_of_files_and_of_other_tables(spark, tmp_path):
    """Rows are told apart in files, and where a table makes several rows of one."""
    from pyspark.sql import functions as F

    from turnloom.llm.common import with_rows

    path = str(tmp_path / "t")
    spark.createDataFrame([(i, "same", [1, 2, 3]) for i in range(20)], "doc_id long, text string, k array<int>").repartition(3).write.parquet(path)
    scan = spark.read.parquet(path)
    for df, n in ((scan, 20), (scan.filter("doc_id < 7").select("doc_id", "text"), 7), (scan.select("doc_id", "text", F.explode("k")), 60), (scan.join(scan.select("text"), "text"), 400)):
        numbers = [r.r for r in with_rows(df, "r").collect()]
        assert len(numbers) == len(set(numbers)) == n
    got = exact.exact_dedup(scan.select("doc_id", "text", F.explode("k")))
    assert got.count() == 60 and got.filter("kept").count() == 1


def test_levels_meet_in_one_table(spark):
    """What follows the last level reads one table: plans, and so the driver's memory, do not grow by levels."""
    df = spark.createDataFrame([(i, "abcd" * (1 + i % 9)) for i in range(36)], "doc_id long, text string")
    found = exact.exact_dedup(df, block_bytes=4)
    assert len({f.rsplit("/", 1)[0] for f in found.inputFiles()}) == 1
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found.collect()} == {(i, 27 + i % 9, 4) for i in range(36)}


def test_long_texts_take_few_levels(spark, monkeypatch):
    """A text of 200 blocks has its name after two levels, so that the driver has few plans and jobs to keep."""
    written = []
    monkeypatch.setattr(exact, "cut", lambda df, write=exact.cut: written.append(df) or write(df))
    texts = ["ab" * 400, "ab" * 400 + "c", "ba" * 400, "ab" * 32, "ab" * 33, "ab"]
    rows = [(i, texts[i % 6]) for i in range(30)]
    assert run(spark, rows, block_bytes=4) == brute(rows)
    assert len([df for df in written if "name" in df.columns]) <= 4
