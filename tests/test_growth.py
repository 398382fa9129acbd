"""Work and memory that must not grow faster than the input."""

import random
import time
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from turnloom.functions import batches, text
from turnloom.operators import candidates, messages, providers


def test_pairs_of_long_messages(spark):
    """Hashes of a message are worked out once, not at each of its places."""
    rng = random.Random(3)
    whole = "".join(rng.choice("abcdefgh ") for _ in range(12_000))
    rows = [(1, "user", 1, whole), (1, "user", 2, whole[5_000:5_060]), (1, "user", 3, whole[7_000:9_000]), (1, "user", 4, whole[:39]), (2, "user", 5, whole[5_000:5_060]), (1, "user", 6, None)]
    df = spark.createDataFrame(rows, "conv long, role string, id long, key string")
    began = time.monotonic()
    got = {(r.a, r.b) for r in messages.near_duplicate_pairs(df, ["conv", "role"], "id", "key").collect()}
    assert got == {(2, 1), (3, 1)}
    assert time.monotonic() - began < 40


def test_composition_of_runs_alone(spark):
    """Texts are composed as a whole would be, while Python is given what may change and no more."""
    rng = random.Random(5)
    signs = "ae ̧́̈é ½ﬁＡ①ｶﾞ゙か각가각…ß̈́\U0001d400\U0001f600ཱིো’漢​\n"
    values = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(3_000)] + ["́", "x́", "né", "é" * 3, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.c for r in df.select("i", text.composed("v").alias("c")).collect()}
    assert got == {i: unicodedata.normalize("NFKC", v or "") for i, v in enumerate(values)}
    whole = "plain café text " * 1_000
    runs = spark.createDataFrame([(whole + "ﬁ" + whole,)], "v string").select(F.regexp_extract_all("v", F.lit(text._OPEN), F.lit(0)).alias("r")).first().r
    assert runs == [" ﬁ"]


def test_noise_collapses_a_text_once(spark):
    """No phrase has the text collapsed anew."""
    for noisy in (text.noise_part("t", "claude"), text.noise_prefix("t", qwen=True)):
        plan = spark.range(1).select(F.lit("Privacy  Policy").alias("t")).select(noisy.alias("n"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("regexp_replace(") == 1 and "regexp_replace(" not in plan.split("lambdafunction(", 1)[1]
    row = spark.createDataFrame([("our Privacy \n POLICY x", "Sign  in now", None)], "a string, b string, c string")
    assert tuple(row.select(text.noise_part("a", "claude"), text.noise_part("b", "claude"), text.noise_part("c", "gemini"), text.noise_prefix("b"), text.noise_prefix("a"), text.noise_prefix("c")).first()) == (True, False, True, True, False, True)


def test_candidates_of_a_long_page(spark):
    """Gates and near copies are settled once for a page or a candidate, not at each candidate of it."""
    turns = "".join(f'<div class="font-user-message">question {i} {"why " * 60}</div><div class="prose"><p>answer {i} {"so " * 60}</p></div>' for i in range(60))
    pages = spark.createDataFrame([(1, "https://claude.ai/share/1", f"<main>{turns}</main>")], "page_id long, url string, html string")
    began = time.monotonic()
    got = candidates.parse_pages(pages).first()
    took = time.monotonic() - began
    want = providers.parse_pages(pages, "claude").first()
    assert len(got.messages) == 120 and [(m.role, m.text) for m in got.messages] == [(m.role, m.text) for m in want.messages]
    assert took < 20


def test_slices_of_batches():
    batch = pa.RecordBatch.from_pydict({"a": list(range(100))})
    parts = list(batches.sliced(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= batches.ROWS and sum((p.column("a").to_pylist() for p in parts), []) == list(range(100))
