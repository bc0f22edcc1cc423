"""Rate limit and streams: hand-worked case, sequential replay, stream = batch."""

import datetime as dt
import hashlib
import random
import tempfile

from pyspark.sql import functions as F

from corpusframe.plans.catalog import QUERIES
from corpusframe.streaming import ingest
from corpusframe.streaming import requests as RQ

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "client string, ts timestamp, event_id long"


def frame(spark, rows):
    return spark.createDataFrame([(c, BASE + dt.timedelta(seconds=t), i) for i, (c, t) in enumerate(rows)], SCHEMA)


def replay(rows, limit, width):
    live, out = {}, {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][1], i)):
        c, t = rows[i]
        mine = [x for x in live.get(c, []) if x > t - width]
        out[i] = len(mine) < limit
        live[c] = mine + [t] if out[i] else mine
    return out


def test_hand_worked(spark):
    rows = [("c", t) for t in (0, 10, 20, 61, 65)]
    got = {r.event_id: r.accepted for r in RQ.rate_limit(frame(spark, rows), 2, 60).collect()}
    assert [got[i] for i in range(5)] == [True, True, False, True, False]
    over = {r.event_id: r.over_limit for r in RQ.arrivals_over(frame(spark, rows), 2, 60).collect()}
    assert [over[i] for i in range(5)] == [False, False, True, True, True]


def test_rate_limit_equals_replay(spark):
    rng = random.Random(2)
    rows = [("idle", t) for t in range(0, 4000, 90)]
    rows += [("busy", rng.randint(0, 1500)) for _ in range(700)]
    rows += [("bursts", b + rng.randint(0, 40)) for b in range(0, 6000, 300) for _ in range(rng.randint(1, 9))]
    rows += [("edge", t) for t in range(0, 1200, 20)]
    want = replay(rows, 4, 60)
    for piece in (60, 4096):
        got = {r.event_id: r.accepted for r in RQ.rate_limit(frame(spark, rows), 4, 60, piece=piece).collect()}
        assert got == want
    counts = {r.event_id: r.arrivals for r in RQ.arrivals_over(frame(spark, rows), 4, 60).collect()}
    for i, (c, t) in enumerate(rows):
        assert counts[i] == sum(1 for j, (d, u) in enumerate(rows) if d == c and t - 60 <= u and (u, j) <= (t, i))


def test_a_client_that_never_pauses_is_replayed_in_pieces(spark):
    rng = random.Random(5)
    rows = [("hot", t + rng.randint(0, 2)) for t in range(0, 3000, 2) for _ in range(rng.randint(1, 3))]
    df = frame(spark, rows)
    counts = df.select("client", F.unix_micros("ts").alias("t")).groupBy("client", "t").agg(F.count("*").alias("n"))
    taken, rounds = RQ.replayed(counts, 3, 60_000_000, "client", piece=250)
    pieces = -(-counts.count() // 250)
    want = replay(rows, 3, 60)
    assert sum(r.taken for r in taken.collect()) == sum(want.values()) and 2 <= rounds <= pieces + 1 and pieces > 4
    assert {r.event_id: r.accepted for r in RQ.rate_limit(df, 3, 60, piece=250).collect()} == want


def test_requests_without_client_or_time_stay(spark):
    rows = [(0, None, 0), (1, None, 1), (2, None, 2), (3, "a", None), (4, None, None), (5, "a", 1)]
    df = spark.createDataFrame(rows, "event_id long, client string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.event_id: r.accepted for r in RQ.rate_limit(df, 2, 60).collect()} == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}
    assert {r.event_id: (r.arrivals, r.over_limit) for r in RQ.arrivals_over(df, 2, 60).collect()} == {
        0: (1, False), 1: (2, False), 2: (3, True), 3: (None, False), 4: (None, False), 5: (1, False)}


def test_limit_zero_is_off(spark):
    assert RQ.rate_limit(frame(spark, [("a", 0), ("a", 0)]), 0, 60).filter("accepted").count() == 2


def test_stream_equals_batch_over_several_batches(spark):
    rng = random.Random(7)
    rows = sorted((rng.choice("ab"), rng.randint(0, 2000)) for _ in range(400))
    rows = sorted(rows, key=lambda r: r[1])
    df = frame(spark, rows)
    root = tempfile.mkdtemp(prefix="spark-")
    for lo in range(0, 400, 100):
        df.filter(f"event_id >= {lo} AND event_id < {lo + 100}").coalesce(1).write.mode("append").parquet(f"{root}/in")
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = RQ.rate_limit_stream(s, 4, 60, "30 minutes")
    q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id: r.accepted for r in spark.read.parquet(f"{root}/out").collect()}
    want = replay(rows, 4, 60)
    assert got and all(want[i] == ok for i, ok in got.items())
    last = max(t for _, t in rows) - 1800
    assert set(got) == {i for i, (_, t) in enumerate(rows) if t <= last}


def test_ingest_adds_every_id_once(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    for n, ids in enumerate((["a", "b", "a", ""], ["b", "c"])):
        spark.createDataFrame([(i, n * 10 + k) for k, i in enumerate(ids)], "chunk_id string, pos int").coalesce(1).write.mode("append").parquet(f"{root}/in")
        s = spark.readStream.schema("chunk_id string, pos int").parquet(f"{root}/in")
        ingest.ingest_stream(s, f"{root}/t", f"{root}/cp", ["pos"]).awaitTermination()
    assert sorted((r.chunk_id, r.pos) for r in spark.read.parquet(f"{root}/t").collect()) == [("a", 0), ("b", 1), ("c", 11)]


def test_ingest_query_reads_a_table_of_several_files(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    rows = [(4, "a"), (2, "b"), (3, "a"), (7, None), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{root}/documents.parquet")
    got = {(r.chunk_id, r.doc_id) for r in QUERIES["stream_ingest"](spark, root).collect()}
    assert got == {(hashlib.md5(b"a").hexdigest(), 3), (hashlib.md5(b"b").hexdigest(), 2), (None, 5)}


def test_metrics_and_exempt_paths(spark):
    df = frame(spark, [("a", 0), ("a", 30), ("b", 70)]).withColumn("ms", F.col("event_id").cast("double"))
    got = sorted((r.client, r.requests, r.mean_latency) for r in RQ.request_metrics(df, "1 minute", "0 seconds", ["client"], "ms").collect())
    assert got == [("a", 2, 0.5), ("b", 1, 2.0)]
    p = spark.createDataFrame([("/health/live",), ("/api/chat",), ("/docs",)], "p string")
    assert [r[0] for r in p.select(RQ.exempt(F.col("p"))).collect()] == [True, False, True]


def test_exempt_paths_are_accepted_and_do_not_count(spark):
    rows = [(i, "a", i, "/health" if i % 2 else "/ask") for i in range(8)]
    events = spark.createDataFrame(rows, "event_id long, client string, s long, path string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.accepted for r in RQ.rate_limit(events, limit=2, seconds=60, path="path").collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False, 5: True, 6: False, 7: True}
