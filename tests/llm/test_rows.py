"""Numbers of rows hold while scans of the source are split anew between jobs."""

import random

import pytest

import corpus_pipeline
from turnloom.llm import exact, minhash, mixing, rlz, sampling, suffix

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def docs(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([70, 90, 130]))) for _ in range(20)]
    rows = [(i, rng.choice(texts) + f" tail{i % 7}" * (i % 3), "en", rng.choice("ab"), 0) for i in range(90)]
    path = str(tmp_path / "documents.parquet")
    for k in range(9):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10 - k % 3], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture
def shifting(spark, monkeypatch):
    """From now on every written table changes how later scans are split."""

    def start():
        for module in (sampling, exact, minhash, mixing, rlz, suffix, corpus_pipeline):

            def moved(df, write=module.cut):
                made = write(df)
                spark.conf.set(SPLIT, "1k" if spark.conf.get(SPLIT) != "1k" else "128m")
                return made

            monkeypatch.setattr(module, "cut", moved)

    before = spark.conf.get(SPLIT)
    yield start
    spark.conf.set(SPLIT, before)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("operator", [lambda df: minhash.near_dedup(df).drop("row"), rlz.substring_dedup, suffix.suffix_dedup])
def test_operators(spark, docs, shifting, operator):
    read = lambda: spark.read.parquet(docs)
    want = rows_of(operator(read()))
    shifting()
    assert rows_of(operator(read())) == want


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup, corpus_pipeline.mix])
def test_stages(spark, docs, shifting, stage):
    run = lambda: stage(spark, spark.read.parquet(docs), "")
    want = rows_of(run())
    shifting()
    # an odd number of changes before the result is read, and an even one
    assert rows_of(run()) == want
    made = run()
    spark.conf.set(SPLIT, "1k" if spark.conf.get(SPLIT) != "1k" else "128m")
    assert rows_of(made) == want


def test_numbers_of_many_files_and_salts(spark, docs):
    """Every row has a number of its own, whatever is read with it; files that share a hash get another salt."""
    from turnloom.llm import common

    df = spark.read.parquet(docs)
    numbered = common.with_rows(df, "row")
    assert numbered.select("row").distinct().count() == df.count() == numbered.count()
    assert numbered.agg({"row": "min"}).first()[0] >= 0
    assert "Join" not in numbered._jdf.queryExecution().optimizedPlan().toString()
    again = common.with_rows(df.filter("doc_id % 2 = 0").select("doc_id"), "row")
    assert again.join(numbered, ["doc_id", "row"]).count() == again.count()
