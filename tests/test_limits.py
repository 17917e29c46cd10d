"""Rate limits: the batch form against a plain log, and a replayed stream against the batch form."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvid.streaming.limits import decide, limit_decisions, limit_stream

START = datetime(2024, 1, 1)


def events(seed=2, n=400):
    rng, out, at = random.Random(seed), [], defaultdict(float)
    for k in range(n):
        who = rng.choice(["a", "a", "a", "b", "c", None])
        at[who] += rng.choice([0.0, 0.2, 1.0, 3.0, 40.0])
        out.append((k, who, START + timedelta(seconds=at[who]) if rng.random() > 0.02 else None))
    return out


def plain(rows, limit, seconds):
    logs, out = defaultdict(deque), {}
    for k, who, at in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        wait = decide(logs[who], int((at - START).total_seconds() * 1_000_000 + 0.5), limit, seconds * 1_000_000)
        out[k] = (who, wait is None, wait)
    return out


def test_decide_logs_only_what_it_allows():
    log = deque()
    assert [decide(log, t, 2, 10) for t in (0, 1, 2, 9, 10, 11)] == [None, None, 1_000_000, 1_000_000, None, None]
    assert decide(deque(), 5, 0, 10) == 10


@pytest.mark.parametrize(("limit", "seconds"), [(3, 5), (1, 2), (10, 60)])
def test_batch_matches_a_plain_log(spark, limit, seconds):
    rows = events()
    df = spark.createDataFrame(rows, "id long, who string, ts timestamp_ntz").repartition(5)
    got = {r.id: (r.who, r.allowed, r.wait_us) for r in limit_decisions(df, "who", "ts", "id", limit, seconds).collect()}
    assert got == plain(rows, limit, seconds) and len({v[1] for v in got.values()}) == 2
    assert limit_decisions(df.limit(0), "who", "ts", "id", limit, seconds).collect() == []


def test_stream_replays_the_batch_and_forgets(spark, tmp_path):
    rows = sorted((r for r in events(5) if r[2]), key=lambda r: (r[2], r[0]))
    kind = "id long, who string, ts timestamp"
    for k in range(4):  # batches in order of time
        part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9999, "late comer", START + timedelta(days=9))], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = limit_stream(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "who", "ts", "id", 3, 5, "1 second")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.id: (r.who, r.allowed, r.wait_us) for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("id") != 9999).collect()}
    want = {r.id: (r.who, r.allowed, r.wait_us) for r in limit_decisions(spark.createDataFrame(rows, kind), "who", "ts", "id", 3, 5).collect()}
    assert got == want
    held = spark.read.format("statestore").option("stateVarName", "log").load(str(tmp_path / "check")).collect()
    assert {r.key.k if hasattr(r.key, "k") else r.key[0] for r in held} <= {"late comer"}
