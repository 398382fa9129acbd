"""Streaming forms: first capture of a turn, and the rate limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ADMITTED = "client string, id long, admitted boolean"


#: Keys are dealt over so many groups of a first-capture stream. Its state is by group, so a stream keeps the number.
GROUPS = 1024


def _first(order: list[str], keep_ms: int):
    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get)) if state.exists else {}
        now, came = state.getCurrentWatermarkMs(), {}
        if not state.hasTimedOut:
            # of what comes in together the first in order; later batches find the key taken
            first = None
            for rows in batches:
                first = (rows if first is None else pd.concat([first, rows], ignore_index=True)).sort_values(order).drop_duplicates("_key")
            came = dict.fromkeys(first["_key"], now + keep_ms)
            new = first[~first["_key"].isin(list(held))]
            if len(new):
                yield new.drop(columns=["_key", "_group"])
        held = {key: until for key, until in held.items() if until >= now} | came
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp(max(now + 1, min(held.values())))
        else:
            state.remove()

    return run


def first_captures(turns: DataFrame, keys: list[str], ts: str, order: list[str], delay: str = "10 minutes", keep_minutes: int = 60) -> DataFrame:
    """The first of turns with equal keys, on a stream. Within a micro-batch turns count in the given
    order, across batches as they arrive; a key is forgotten once the watermark has gone so far past it.
    Many keys share a call and a state, as a call costs some milliseconds whatever it is given."""
    timed = turns.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    key = F.to_json(F.array(*(F.col(k).cast("string") for k in keys)))
    dealt = timed.withColumn("_key", key).withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(GROUPS)))
    return dealt.groupBy("_group").applyInPandasWithState(_first(order, keep_minutes * 60_000), timed.schema, "keys array<string>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def counts(requests: DataFrame, client: str, ts: str, window: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Requests per client and window, on a stream."""
    timed = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, window).alias("slot"), F.col(client).alias("client")).agg(F.count("*").alias("n"))


def _limiter(limit: int, keep_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = dict(zip(*state.get)) if state.exists else {}
        if not state.hasTimedOut:
            batch = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "id"])
            slots = batch["slot"].astype("int64")
            number = batch.groupby(slots).cumcount() + 1 + slots.map(seen).fillna(0).astype("int64")
            for slot, n in slots.value_counts().items():
                seen[slot] = seen.get(slot, 0) + int(n)
            yield pd.DataFrame({"client": batch["client"], "id": batch["id"], "admitted": number <= limit})
        passed = state.getCurrentWatermarkMs() - keep_ms
        seen = {k: n for k, n in seen.items() if k > passed}
        if seen:
            state.update((list(seen), list(seen.values())))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, max(seen) + keep_ms))
        else:
            state.remove()

    return run


def rate_limit(requests: DataFrame, client: str, ts: str, ident: str, limit: int = 20, minutes: int = 15, delay: str = "1 hour") -> DataFrame:
    """Requests with ``admitted``, on a stream: the first ``limit`` of a client in each epoch-aligned
    window. A client's counts are kept until the watermark has left their windows. Within a micro-batch
    requests count in order of time and id."""
    timed = requests.select(F.col(client).cast("string").alias("client"), F.col(ident).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    size = minutes * 60_000
    timed = timed.withColumn("slot", F.unix_millis("ts") - F.pmod(F.unix_millis("ts"), F.lit(size)))
    return timed.groupBy("client").applyInPandasWithState(_limiter(limit, size), ADMITTED, "slots array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
