"""Scrolling captures as one stream: turns of pages come in polls, in any order, over many micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that maps and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BODIES = "page_id long, n_turns long, n_seen long, body string"
#: Pages are keyed as text: beside a row without a page pandas makes numbers floats, which are no keys of the state.
_PAGE = lambda: F.col("page_id").cast("long").cast("string").alias("page_id")
STOPS = "page_id long, n_steps long, n_turns long, stopped string"


class _Page(StatefulProcessor):
    """A page's turns by key, each the first in page order, until nothing has come for idle_ms."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "key string", "pos long, html string")
        self.seen = handle.getValueState("seen", "last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return iter(())
        last, n = self.seen.get() if self.seen.exists() else (None, 0)
        latest = last
        for batch in rows:
            batch = batch.dropna(subset=["key", "pos", "ms"])
            if batch.empty:
                continue
            n += len(batch)
            # of what comes in together only the first turn of a key asks the state
            first = batch.sort_values("pos").drop_duplicates("key")
            for name, pos, html in zip(first["key"], first["pos"], first["html"]):
                if not self.turns.containsKey((name,)) or int(pos) < self.turns.getValue((name,))[0]:
                    self.turns.updateValue((name,), (int(pos), html))
            newest = int(batch["ms"].max())
            latest = newest if latest is None else max(latest, newest)
        if latest != last:
            if last is not None:
                self.handle.deleteTimer(last + self.idle_ms)
            self.handle.registerTimer(latest + self.idle_ms)
        if latest is not None:
            self.seen.update((latest, n))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = sorted(tuple(value) for _, value in self.turns.iterator())
        made = {"page_id": [int(key[0])], "n_turns": [len(kept)], "n_seen": [self.seen.get()[1]], "body": ["\n".join(html for _, html in kept)]}
        self.turns.clear()
        self.seen.clear()
        yield pd.DataFrame(made)

    def close(self) -> None:
        pass


def page_bodies(turns: DataFrame, idle: int = 60, delay: str = "1 hour") -> DataFrame:
    """``page_id, n_turns, n_seen, body`` of a stream of turns (page_id, key, pos, html, ts), once the
    watermark is ``idle`` seconds past a page's last turn: of turns of one key the first by ``pos``, in that
    order, however they came. A page's state ends with its body.

    Rows without page, key, place or time only move the watermark (they are not filtered: a filter would
    go below the watermark). Turns that come later than ``delay`` go; a page that
    is seen anew after its body has another one. Of equal ``pos`` and key the one that came first stays.
    """
    timed = turns.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    html = F.when(F.col("page_id").isNotNull() & F.col("key").isNotNull(), F.col("html")).alias("html")
    rows = timed.select(_PAGE(), "key", "pos", html, "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("page_id").transformWithStateInPandas(_Page(idle * 1000), BODIES, "Append", "EventTime")


class _Scroll(StatefulProcessor):
    """A page's polls folded in the order of their steps, until no more turns come up."""

    def __init__(self, steps: int, still: int, slack: int, idle_ms: int):
        self.steps, self.still, self.slack, self.idle_ms = steps, still, slack, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: The last step folded (-1: none), its place, how many polls in a row brought nothing, the timer; the
        #: polls that wait, of ``steps`` steps at most, and the keys seen. One value: each call of the state
        #: costs a message to it, so a page is read and written once for all polls that come together.
        polls = "array<struct<step:long,top:long,bottom:long,keys:array<string>>>"
        self.at = handle.getValueState("at", f"step long, top long, still long, latest long, done boolean, waiting {polls}, seen array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return
        step, top, still, latest, done, waiting, seen = self._load()
        before = latest
        for batch in rows:
            batch = batch.dropna(subset=["step", "top", "bottom", "ms"])
            if batch.empty:
                continue
            newest = int(batch["ms"].max())
            latest = newest if latest is None else max(latest, newest)
            batch = batch[(batch["step"] > step) & (batch["step"] <= self.steps) & (not done)].sort_values(["step", "top", "bottom"])
            for at, *place, keys in zip(batch["step"], batch["top"], batch["bottom"], batch["keys"]):
                waiting.setdefault(int(at), (*map(int, place), [k for k in (() if keys is None else keys) if k is not None]))
        if latest is None:
            return
        if latest != before:
            if before is not None:
                self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(latest + self.idle_ms)
        step, top, still, why = (step, top, still, None) if done else self._fold(step, top, still, waiting, seen, gaps=False)
        if why:
            yield self._row(key, step, len(seen), why)
            waiting, seen = {}, {}
        self.at.update((step, top, still, latest, done or why is not None, [(at, *poll) for at, poll in waiting.items()], list(seen)))

    def _load(self) -> tuple:
        if not self.at.exists():
            return -1, -1, 0, None, False, {}, {}
        *known, waiting, seen = self.at.get()
        return *known, {p[0]: (p[1], p[2], list(p[3])) for p in waiting}, dict.fromkeys(seen)

    def _fold(self, step: int, top: int, still: int, waiting: dict, seen: dict, gaps: bool) -> tuple:
        why = None
        for at in sorted(waiting):
            if why or (at != step + 1 and not gaps):
                break
            here, bottom, keys = waiting.pop(at)
            new = [k for k in keys if k not in seen]
            seen.update(dict.fromkeys(new))
            # the first poll looks before anything has moved
            still = still + 1 if step >= 0 and not new and (here >= bottom - self.slack or here == top) else 0
            step, top = at, here
            why = "still" if still >= self.still else "steps" if step >= self.steps else None
        return step, top, still, why

    def _row(self, key, step: int, turns: int, why: str) -> pd.DataFrame:
        return pd.DataFrame({"page_id": [int(key[0])], "n_steps": [step], "n_turns": [turns], "stopped": [why]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step, top, still, _, done, waiting, seen = self._load()
        if not done:
            step, top, still, why = self._fold(step, top, still, waiting, seen, gaps=True)
            if step >= 0:
                yield self._row(key, step, len(seen), why or "idle")
        self.at.clear()

    def close(self) -> None:
        pass


def scroll_stops(polls: DataFrame, steps: int = 72, still: int = 3, slack: int = 8, idle: int = 60, delay: str = "1 hour") -> DataFrame:
    """``page_id, n_steps, n_turns, stopped`` of a stream of polls (page_id, step, top, bottom, keys, ts): where
    a scrolling capture stops. Step 0 looks before the page moves. A poll is still if it finds no new turn and
    is at the bottom, within ``slack``, or where it was before. It stops at the last of ``still`` such polls in
    a row ("still"), after ``steps`` ("steps"), or once the watermark is ``idle`` seconds past the last poll
    ("idle").

    Polls may come in any order: a poll waits for the step before it, at most ``steps`` of a page do, and
    steps that never came are passed over when the page is idle. Of a step that comes twice the first stays.
    Polls after the stop change nothing, and once idle a page is forgotten. Rows without page, step, place
    or time count for nothing; polls later than ``delay`` go; keys may be null, empty or repeated.
    """
    timed = polls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = timed.select(_PAGE(), "step", "top", "bottom", "keys", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("page_id").transformWithStateInPandas(_Scroll(steps, still, slack, idle * 1000), STOPS, "Append", "EventTime")
