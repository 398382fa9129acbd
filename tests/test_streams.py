"""The capture streams: turns and polls in any order over several micro-batches, and state that ends."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnloom.plans import streams
from turnloom.sources import tables
from turnloom.streaming import captures, turns

POLLS = "page_id long, key string, pos long, html string, ts long"


STEPS = "page_id long, step long, top long, bottom long, keys array<string>, ts long"


@pytest.fixture
def fed(spark, tmp_path):
    before = spark.conf.get(streams._STORE, None)
    spark.conf.set(streams._STORE, captures.STORE)

    def run(batches, made, given, gives):
        """One micro-batch or more for each list of rows, from the state of those before."""
        for rows in batches:
            spark.createDataFrame(rows, given).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            schema = spark.read.parquet(str(tmp_path / "in")).schema
            found = made(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), idle=60, delay="100 seconds")
            found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        return sorted((tuple(r) for r in spark.read.schema(gives).parquet(str(tmp_path / "out")).collect()), key=str)

    yield run
    spark.conf.unset(streams._STORE) if before is None else spark.conf.set(streams._STORE, before)


@pytest.fixture
def feed(fed):
    return lambda *batches: fed(batches, captures.page_bodies, POLLS, captures.BODIES)


@pytest.fixture
def stops(fed):
    return lambda *batches: fed(batches, captures.scroll_stops, STEPS, captures.STOPS)


def test_turns_come_scrambled(feed):
    first = [(1, "b", 2, "B", 1000), (2, "x", 0, "X", 1001)]
    second = [(1, "a", 9, "later", 1010), (1, "b", 5, "other", 1011), (1, "a", 1, "A", 1012), (None, "n", 1, "N", 1012), (1, None, 0, "N", 1012), (1, "p", None, "N", 1012)]
    third = [(1, "a", 0, "first", 1020), (1, "c", 7, "C", 1020)]
    assert feed(first, second, third) == []
    # page 2 is idle when the watermark passes 1061, page 1 when it passes 1080
    assert feed([(3, "z", 0, "Z", 1170)]) == [(2, 1, 1, "X")]
    assert feed([(None, None, None, None, 1400)]) == [(1, 3, 6, "first\nB\nC"), (2, 1, 1, "X"), (3, 1, 1, "Z")]


def test_late_turns_go_and_pages_begin_anew(feed):
    assert feed([(1, "a", 0, "A", 1000)], [(None, None, None, None, 2000)]) == [(1, 1, 1, "A")]
    # 1500 is past the watermark of 1900, and nothing of the page's first document is known any more
    assert feed([(1, "b", 1, "late", 1500), (1, "a", 0, "new", 2100)], [(None, None, None, None, 3000)]) == [(1, 1, 1, "A"), (1, 1, 1, "new")]


def plain_stop(polls):
    """By the loop: polls of one page as (step, top, bottom, keys), each step once."""
    seen, still, last, before = set(), 0, -1, None
    for step, top, bottom, keys in sorted(polls):
        if step > 72:
            break
        new = {k for k in keys or () if k is not None} - seen
        seen |= new
        still = still + 1 if before is not None and not new and (top >= bottom - 8 or top == before) else 0
        last, before = step, top
        if still >= 3 or step >= 72:
            return last, len(seen), "still" if still >= 3 else "steps"
    return last, len(seen), "idle"


def test_scrolling_stops_as_the_loop_does(stops):
    rng = random.Random(3)
    pages = {}
    for page in range(40):
        bottom = 100 * rng.randrange(100)
        chance = rng.choice([0.05, 0.3, 0.9])
        pages[page] = [(step, rng.choice([min(100 * step, bottom), max(0, bottom - 8), bottom - 9]), bottom, [str(rng.randrange(200)), None, ""] if rng.random() < chance else rng.choice([None, [], [""]])) for step in range(rng.choice([1, 2, 5, 40, 90]))]
        # some steps never come, and later ones are passed on to when the page is idle
        pages[page] = [p for p in pages[page] if rng.random() < 0.98] or pages[page][:1]
    rows = [(page, *poll, 1000 + poll[0] % 50) for page, polls in pages.items() for poll in polls]
    rng.shuffle(rows)
    # a step that comes twice at once, or rows without page, step, place or time, change nothing
    rows += [rng.choice(rows) for _ in range(20)] + [(None, 0, 0, 0, ["n"], 1000), (0, None, 0, 0, ["n"], 1000), (0, 1, None, 0, ["n"], 1000)]
    end = [(None, None, None, None, None, 5000)]
    got = stops(rows[::3], rows[1::3], rows[2::3], end)
    want = sorted(((page, *plain_stop(polls)) for page, polls in pages.items()), key=str)
    assert got == want and {w[3] for w in want} == {"still", "steps", "idle"}


def test_polls_after_the_stop_change_nothing_until_the_page_is_forgotten(stops):
    first = [(1, step, 0, 0, ["a"], 1000) for step in range(4)]
    assert stops(first) == [(1, 3, 1, "still")]
    assert stops([(1, 4, 0, 0, ["b"], 1010)], [(None, None, None, None, None, 2000)]) == [(1, 3, 1, "still")]
    assert stops([(1, 0, 0, 0, ["c", "d"], 2100)], [(None, None, None, None, None, 3000)]) == [(1, 0, 2, "idle"), (1, 3, 1, "still")]


CHATS = "page_id long, url string, title string, messages array<struct<role:string,text:string>>, error string"


def test_a_repeated_batch_changes_neither_table(spark, tmp_path):
    chats = spark.createDataFrame([(1, "u", "t", [("user", "q"), ("assistant", 'a "é"')], None), (2, "v", None, [], "none"), (None, None, None, None, None)], CHATS)
    write = tables.batch_writer(lambda batch: batch, str(tmp_path))
    read = lambda: [sorted(map(str, df.collect())) for df in tables.read_batches(spark, str(tmp_path))]
    write(chats, 0)
    once = read()
    assert [len(rows) for rows in once] == [2, 1] and "a \"é\"" in once[0][0] + once[0][1]
    write(chats, 0)
    assert read() == once
    write(chats.limit(0), 1)
    assert read() == once
    write(chats, 2)
    assert [len(rows) for rows in read()] == [4, 2]


def test_a_batch_that_fails_halfway_comes_again(spark, tmp_path):
    """The second batch fails after its good ones are written; the stream goes on from its log."""
    given = spark.createDataFrame([(i, "u", "t", [("user", str(i))], "bad" if i % 3 == 0 else None) for i in range(12)], CHATS)
    given.repartition(3, "page_id").write.parquet(str(tmp_path / "in"))
    once = tables.batch_writer(lambda batch: batch, str(tmp_path))
    failed = []

    def write(batch, batch_id):
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            tables.write_conversations(batch, f"{tmp_path}/good/batch=1")
            raise ValueError("halfway")
        once(batch, batch_id)

    def start():
        stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="halfway"):
        start()
    start()
    good, bad = tables.read_batches(spark, str(tmp_path))
    assert sorted(r.page_id for r in good.collect()) == [i for i in range(12) if i % 3] and sorted(r.page_id for r in bad.collect()) == [0, 3, 6, 9]


def test_batches_of_many_files(spark, tmp_path, monkeypatch):
    """A micro-batch of pages is read by many tasks, not as a single file by one."""
    monkeypatch.setattr(streams, "_folder", lambda spark, kind: str(tmp_path / kind))
    pages = spark.range(300).selectExpr("id AS page_id", "CAST(NULL AS STRING) AS url", "concat('text ', id) AS html")
    made = lambda b: b.selectExpr("page_id", "url", "array(named_struct('role', 'user', 'text', html)) AS messages", "CASE WHEN page_id % 3 = 0 THEN 'bad' END AS error")
    good, bad = streams.stored_batches(spark, pages, made)
    assert (good.select("page_id").distinct().count(), bad.select("page_id").distinct().count()) == (200, 100) and good.count() + bad.count() == 300
    assert len(list((tmp_path / "batches" / "in").glob("*.parquet"))) == 3 * spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "batches" / "good").glob("batch=*"))) == 3


def test_scrolling_asks_the_state_once_for_many_polls():
    """However many polls of a page come together, its state is read and written once."""
    calls = []

    class State:
        def __init__(self, *schema):
            self.value = None

        def __getattr__(self, name):
            calls.append(name)
            return {"exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "containsKey": lambda k: False, "keys": lambda: iter(())}.get(name, lambda *a: None)

    class Handle:
        getValueState = getMapState = State
        registerTimer = deleteTimer = lambda self, at: None

    page = captures._Scroll(72, 3, 8, 60_000)
    page.init(Handle())
    polls = pd.DataFrame({"step": range(50), "top": range(50), "bottom": [900] * 50, "keys": [[f"k{i}"] for i in range(50)], "ms": range(50)})
    assert list(page.handleInputRows(("1",), iter([polls]), None)) == []
    assert len(calls) <= 3


def test_first_captures_over_batches(spark, tmp_path):
    """A key is taken by what came first, and free again once the watermark has left it behind; of one batch
    the first in order counts, and null is a key."""
    schema = "id long, a long, b string, ts timestamp"
    batches = [
        [(3, 1, "x", 100), (2, 1, "x", 100), (4, 1, None, 50), (5, None, "null", 70), (6, None, None, 71)],
        [(1, 1, "x", 90), (7, 1, "y", 20_000), (8, 1, None, 100)],
        [(9, 2, "z", 30_000)],
        [(10, 1, "x", 31_000), (11, 1, "y", 31_000), (12, 1, "y", 30_900)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "id long, a long, b string, ts long").withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = turns.first_captures(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["a", "b"], "ts", ["ts", "id"], keep_minutes=60)
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(schema).parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in got.collect()) == [2, 4, 5, 6, 7, 9, 10, 12]


def test_first_captures_of_many_keys(spark, tmp_path):
    """A key does not cost a call of its own."""
    spark.range(40_000).select("id", (F.col("id") % 20_000).alias("a"), F.timestamp_seconds(F.col("id") + 10**6).alias("ts")).write.parquet(str(tmp_path / "in"))
    began = time.monotonic()
    found = turns.first_captures(spark.readStream.schema("id long, a long, ts timestamp").parquet(str(tmp_path / "in")), ["a"], "ts", ["ts"])
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    took = time.monotonic() - began
    got = spark.read.schema("id long, a long, ts timestamp").parquet(str(tmp_path / "out"))
    assert got.count() == 20_000 and got.filter("id <> a").count() == 0
    assert took < 25
