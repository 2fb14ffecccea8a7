"""Sliding-window admission per key: a request passes if fewer than N admitted ones lie in the last W seconds.

Rejected requests don't count, so admission depends on earlier admissions: state, not a window aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: endpoint -> (admitted requests at most, seconds)
LIMITS = {"chat": (20, 60), "change": (10, 60), "ingest": (5, 60), "metrics": (10, 60)}
OUT = "user_id long, endpoint string, ts timestamp, request_id long, allowed boolean, remaining int"


def admit(times: list[int], admitted: list[int], most: int, window: int) -> tuple[list[bool], list[int]]:
    """(allowed, remaining) of requests in time order (microseconds); ``admitted`` holds and keeps the state.

    The window is strict: a request exactly ``window`` seconds after another doesn't see it.
    """
    allowed, remaining, first = [], [], 0
    for t in times:
        while first < len(admitted) and admitted[first] <= t - window * 1_000_000:
            first += 1
        ok = len(admitted) - first < most
        if ok:
            admitted.append(t)
        allowed.append(ok)
        remaining.append(most - (len(admitted) - first))
    del admitted[:first]
    return allowed, remaining


def _micros(ts: pd.Series) -> list[int]:
    return (ts.astype("datetime64[us]").astype("int64")).tolist()


def batch(requests: DataFrame, most: int = 10, window: int = 60, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """requests (user_id, endpoint, ts, request_id) with allowed and remaining, in order of ts and request_id.

    An endpoint that ``limits`` names (LIMITS has the usual ones) has its own number of requests and seconds, others have ``most`` and ``window``.
    Sorted by user, endpoint and time, requests are folded as they stream through a task, which holds one
    batch and the admitted times of the last window, however many requests a user makes.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, admitted = None, []
        for batch in batches:
            users, endpoints = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            times = batch.column(2).cast(pa.int64()).to_pylist()
            allowed, remaining, begin = [], [], 0
            while begin < len(times):
                now, end = (users[begin], endpoints[begin]), begin + 1
                while end < len(times) and (users[end], endpoints[end]) == now:
                    end += 1
                if now != key:
                    key, admitted = now, []
                ok, left = admit(times[begin:end], admitted, *(limits or {}).get(now[1], (most, window)))
                allowed += ok
                remaining += left
                begin = end
            yield pa.record_batch([*batch.columns, pa.array(allowed, pa.bool_()), pa.array(remaining, pa.int32())], [*batch.schema.names, "allowed", "remaining"])

    rows = requests.select(F.col("user_id").cast("long"), "endpoint", F.col("ts").cast("timestamp").alias("ts"), F.col("request_id").cast("long"))
    return rows.repartition("user_id", "endpoint").sortWithinPartitions("user_id", "endpoint", "ts", "request_id").mapInArrow(fold, OUT)


def stream(requests: DataFrame, most: int = 10, window: int = 60, lateness: str = "1 minute", limits: dict[str, tuple[int, int]] | None = None, buckets: int = 1024) -> DataFrame:
    """The same on a stream: the state holds the admitted times of each key's last window, dropped when they expire.

    Keys are dealt to ``buckets``, each one group of state, so a micro-batch costs by its requests and not by a call per key; more keys need more buckets.
    Requests later than ``lateness`` behind the newest are dropped by the watermark.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def limit(endpoint: str) -> tuple[int, int]:
        return (limits or {}).get(endpoint, (most, window))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        timed_out, mark = state.hasTimedOut, state.getCurrentWatermarkMs()
        held = {(u, e): list(times) for u, e, times in zip(*state.get, strict=True)} if state.exists else {}
        if not timed_out:
            rows = pd.concat(list(frames)).sort_values(["user_id", "endpoint", "ts", "request_id"])
            users, endpoints = ([None if pd.isna(x) else x for x in rows[c].tolist()] for c in ("user_id", "endpoint"))
            users, times = [u if u is None else int(u) for u in users], _micros(rows["ts"])
            allowed, remaining, begin = [], [], 0
            while begin < len(times):
                now, end = (users[begin], endpoints[begin]), begin + 1
                while end < len(times) and (users[end], endpoints[end]) == now:
                    end += 1
                ok, left = admit(times[begin:end], held.setdefault(now, []), *limit(now[1]))
                allowed += ok
                remaining += left
                begin = end
            rows["allowed"], rows["remaining"] = allowed, remaining
        # what no request at or after the watermark can see any more goes
        ends = {k: times[-1] // 1000 + limit(k[1])[1] * 1000 + 1 for k, times in held.items() if times}
        held = {k: held[k] for k, end in ends.items() if end > mark}
        if held:
            state.update(([k[0] for k in held], [k[1] for k in held], list(held.values())))
            state.setTimeoutTimestamp(max(mark + 1, min(ends[k] for k in held)))
        elif state.exists:
            state.remove()
        if not timed_out:
            yield rows[["user_id", "endpoint", "ts", "request_id", "allowed", "remaining"]]

    rows = requests.select("user_id", "endpoint", F.col("ts").cast("timestamp").alias("ts"), "request_id").withWatermark("ts", lateness)
    groups = rows.withColumn("bucket", F.pmod(F.hash("user_id", "endpoint"), F.lit(buckets))).groupBy("bucket")
    return groups.applyInPandasWithState(step, OUT, "users array<long>, endpoints array<string>, admitted array<array<long>>", "append", GroupStateTimeout.EventTimeTimeout)
