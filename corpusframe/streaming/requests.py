"""Request streams: sliding rate limit, breach monitor, metrics. Batch and streaming forms."""

from __future__ import annotations

import sys
from collections import deque

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.operators.ordered import _same, numbered
from corpusframe.settings import durable

# The functions run in tasks travel with the job: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Paths that no limit holds for.
EXEMPT = ["/", "/api/info", "/api/metrics", "/docs", "/redoc", "/openapi.json"]


def exempt(path: Column, listed=EXEMPT) -> Column:
    return path.isin(listed) | F.startswith(path, F.lit("/health"))


# --- batch rate limit --------------------------------------------------------------------------

def _with_previous_slice(counts: DataFrame, slice_us: int) -> DataFrame:
    """Rows of a time slice together with copies (``ctx``) of the slice before it."""
    b = F.floor(F.col("t") / slice_us).cast("long")
    both = F.array(F.struct(b.alias("slice"), F.lit(False).alias("ctx")), F.struct((b + 1).alias("slice"), F.lit(True).alias("ctx")))
    return counts.select("*", F.inline(both))


def arrivals_over(events: DataFrame, limit: int, seconds: int, key: str = "client", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """Arrivals of the client in the window ending at every request, and whether they exceed the limit.

    Equal times are counted first; a client's time line is then cut into slices, each handled with a
    copy of the slice before it, so a client with a third of all requests is spread over its slices. Requests
    without a client are those of one client; a request without a time has no window: its arrivals are null and it is not over.
    """
    width = seconds * 1_000_000
    c = events.filter(F.col(ts).isNotNull()).select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).groupBy(key, "t").agg(F.count("*").alias("n"))
    s = _with_previous_slice(c, width + 1)
    w = W.partitionBy(key, "slice").orderBy("t").rangeBetween(-width, 0)
    upto = s.withColumn("__upto", F.sum("n").over(w)).filter("NOT ctx").select(key, "t", "n", "__upto")
    timed = events.filter(F.col(ts).isNotNull()).withColumn("t", F.unix_micros(F.col(ts).cast("timestamp")))
    j = _same(timed, upto, [key, "t"])
    place = F.row_number().over(W.partitionBy(key, "t").orderBy(event))
    arrivals = (F.col("__upto") - F.col("n") + place).cast("long")
    counted = j.withColumn("arrivals", arrivals).drop("t", "n", "__upto")
    return counted.unionByName(events.filter(F.col(ts).isNull()).withColumn("arrivals", F.lit(None).cast("long"))) \
        .withColumn("over_limit", F.coalesce(F.col("arrivals") > limit, F.lit(False)))


#: Times of one client that are replayed together.
PIECE = 4096


def _decide(ts, ns, live: deque, limit: int, width: int) -> np.ndarray:
    """Requests taken at each time, in order, from the accepted (time, requests) of the last window in ``live``, which is carried on."""
    held = sum(n for _, n in live)
    taken = np.zeros(len(ts), dtype=np.int64)
    for i in range(len(ts)):
        while live and live[0][0] <= ts[i] - width:
            held -= live.popleft()[1]
        take = min(int(ns[i]), limit - held)
        if take > 0:
            live.append((int(ts[i]), take))
            held += take
            taken[i] = take
    return taken


def _piece(limit: int, width: int, key: str, ends: bool):
    """Replays one piece from the state it starts with: its end state, or the requests taken at each of its times."""
    def run(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        live = deque((int(x["t"]), int(x["n"])) for x in start["live"].iloc[0]) if len(start) and start["live"].iloc[0] is not None else deque()
        taken = _decide(rows["t"].to_numpy(), rows["n"].to_numpy(), live, limit, width) if len(rows) else np.zeros(0, np.int64)
        if not ends:
            return rows[[key, "t"]].assign(taken=taken)
        if not len(rows) or not len(start):
            return pd.DataFrame({"__k": [], "piece": [], "live": []})
        last = int(rows["t"].iloc[-1])
        return pd.DataFrame({"__k": rows["__k"].iloc[:1], "piece": rows["piece"].iloc[:1] + 1, "live": [[{"t": t, "n": n} for t, n in live if t > last - width]]})
    return run


def replayed(counts: DataFrame, limit: int, width: int, key: str, piece: int = PIECE) -> tuple[DataFrame, int]:
    """(``key``, t, taken; rounds) of requests counted by (``key``, t): parallel in time.

    A client's line is cut anywhere into pieces of ``piece`` times. All pieces are replayed from a guess, an empty
    window; the end of each is the start of the next, and pieces that started with anything else are replayed until none
    does. A start is at most ``limit`` times, and a pause anywhere in a piece makes its end the same whatever
    it started with, so a few rounds settle most lines; a line that never pauses takes as many rounds as its pieces at
    worst, and only changed pieces are replayed in each.
    """
    rows = durable(numbered(counts.withColumn("__k", F.xxhash64(F.col(key).isNull(), key)), ["__k", key], ["t"], "__pos").select(
        "__k", key, F.floor(F.col("__pos") / piece).cast("long").alias("piece"), "t", "n"))
    state = "array<struct<t:bigint,n:bigint>>"
    nothing = F.array().cast(state)
    starts = durable(rows.select("__k", "piece").distinct().withColumn("live", nothing))
    changed, rounds = starts, 0
    while True:
        rounds += 1
        kept = rows.join(changed.select("__k", "piece"), ["__k", "piece"], "left_semi")
        ends = kept.groupBy("__k", "piece").cogroup(changed.groupBy("__k", "piece")).applyInPandas(_piece(limit, width, key, True), f"__k long, piece long, live {state}")
        news = ends.withColumnRenamed("live", "fresh")
        merged = durable(starts.join(news, ["__k", "piece"], "left").select(
            "__k", "piece", F.coalesce("fresh", "live").alias("live"), (F.coalesce("fresh", "live") != F.col("live")).alias("moved")))
        starts, changed = merged.drop("moved"), merged.filter("moved").drop("moved")
        if changed.isEmpty():
            break
    kind = counts.schema[key].dataType.simpleString()
    taken = rows.groupBy("__k", "piece").cogroup(starts.groupBy("__k", "piece")).applyInPandas(_piece(limit, width, key, False), f"{key} {kind}, t long, taken long")
    return taken, rounds


def rate_limit(events: DataFrame, limit: int = 60, seconds: int = 60, key: str = "client", ts: str = "ts", event: str = "event_id",
               piece: int = PIECE, path: str | None = None) -> DataFrame:
    """Adds ``accepted``: a request is rejected when ``limit`` accepted ones lie in the last ``seconds``.

    Only accepted requests count, so a client's requests have to be replayed in order: equal times are counted first,
    and the line of a client is replayed in pieces at the same time (``replayed``), so a client with most of all requests,
    and one that never pauses, is many tasks. Requests without a client are those of one client; a request without
    a time is accepted and does not count. With ``path``, requests of exempt paths are accepted and do not count.
    """
    free = F.col(ts).isNull()
    if path is not None:
        free = free | F.coalesce(exempt(F.col(path)), F.lit(False))
    if limit <= 0:
        return events.withColumn("accepted", F.lit(True))
    timed = events.filter(~free).withColumn("t", F.unix_micros(F.col(ts).cast("timestamp")))
    counts = timed.groupBy(key, "t").agg(F.count("*").alias("n"))
    taken, _ = replayed(counts, limit, seconds * 1_000_000, key, piece)
    j = _same(timed, taken, [key, "t"])
    place = F.row_number().over(W.partitionBy(key, "t").orderBy(event))
    decided = j.withColumn("__p", place).withColumn("accepted", F.col("__p") <= F.col("taken")).drop("t", "taken", "__p")
    return decided.unionByName(events.filter(free).withColumn("accepted", F.lit(True)))


# --- streaming rate limit ----------------------------------------------------------------------

def rate_limit_stream(stream: DataFrame, limit: int = 60, seconds: int = 60, delay: str = "10 minutes", key: str = "client",
                      ts: str = "ts", event: str = "event_id", path: str | None = None) -> DataFrame:
    """The same decision on a stream, in event time.

    Requests wait in keyed state until the watermark has passed them and are then decided in order;
    a request later than the watermark is dropped. State holds accepted times of the last window and
    waiting requests, and is removed when both are gone. With ``path``, requests of exempt paths are
    left out: they need no decision. Output: client, event_id, t, accepted.
    """
    if path is not None:
        stream = stream.filter(~F.coalesce(exempt(F.col(path)), F.lit(False)))
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
    width = seconds * 1_000_000

    def step(group, batches, state: GroupState):
        live, wait_t, wait_e = ([list(x) for x in state.get] if state.exists else ([], [], []))
        for part in batches:
            wait_t += [int(x) for x in part["t"]]
            wait_e += [int(x) for x in part["event_id"]]
        mark = state.getCurrentWatermarkMs() * 1000
        order = sorted(zip(wait_t, wait_e))
        out, rest = [], []
        for t, e in order:
            if t > mark:
                rest.append((t, e))
                continue
            live = [x for x in live if x > t - width]
            ok = len(live) < limit
            if ok:
                live.append(t)
            out.append((group[0], e, t, ok))
        live = [x for x in live if x > mark - width]
        if live or rest:
            state.update((live, [t for t, _ in rest], [e for _, e in rest]))
            wake = rest[0][0] if rest else live[-1] + width
            state.setTimeoutTimestamp(max(mark // 1000, wake // 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["client", "event_id", "t", "accepted"])

    s = stream.select(F.col(key).alias("client"), F.col(event).alias("event_id"), F.col(ts).alias("ts")).withWatermark("ts", delay)
    s = s.withColumn("t", F.unix_micros(F.col("ts")))
    kind = stream.schema[key].dataType.simpleString()
    return s.groupBy("client").applyInPandasWithState(
        step, f"client {kind}, event_id long, t long, accepted boolean", "live array<long>, wait_t array<long>, wait_e array<long>",
        "append", GroupStateTimeout.EventTimeTimeout)


# --- monitors ------------------------------------------------------------------------------------

def breach_monitor(stream: DataFrame, limit: int, size: str, slide: str, delay: str, key: str = "client", ts: str = "ts") -> DataFrame:
    """Clients whose arrivals in a sliding window exceed the limit (works on streams and tables)."""
    return stream.withWatermark(ts, delay).groupBy(key, F.window(ts, size, slide).alias("w")).agg(F.count("*").alias("arrivals")) \
        .filter(F.col("arrivals") > limit).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "arrivals")


def request_metrics(stream: DataFrame, size: str, delay: str, keys: list[str], latency: str, ts: str = "ts") -> DataFrame:
    """Requests and latency by tumbling window and ``keys`` (works on streams and tables)."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), *keys).agg(
        F.count("*").alias("requests"), F.avg(latency).alias("mean_latency"), F.max(latency).alias("max_latency")) \
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "requests", "mean_latency", "max_latency")
