"""Streaming forms against their batch twins, over files that arrive in steps."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrylake.operators.memory import LIFECYCLE
from quarrylake.streaming import stateful as SF, streams as ST


@pytest.fixture(scope="module")
def events(spark, small):
    return spark.read.parquet(f"{small}/events.parquet")


def drain(stream, spark, mode="append", name="out"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


@pytest.fixture
def folder(events, tmp_path):
    events.orderBy("ts").coalesce(1).write.parquet(f"file://{tmp_path}/e")
    return f"file://{tmp_path}/e"


def test_rate(spark, events, folder):
    live = ST.rate_counts(ST.event_stream(spark, folder, events.schema), ["event_type"])
    got = drain(live, spark, "complete", "rate")
    want = ST.rate_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert ST.over_limit(events.withColumn("ts", F.lit("2024-01-01 00:00:01").cast("timestamp")), ["event_type"], 3).count() == 5


def test_repeats(spark, events, folder):
    live = ST.drop_repeats(ST.event_stream(spark, folder, events.schema), ["user_id", "event_type"])
    assert 0 < drain(live, spark, name="repeats").count() <= events.count()


def test_counts_kept(spark, events, tmp_path, folder):
    signed = ST.event_stream(spark, folder, events.schema).withColumn("sign", F.when(F.col("event_id") % 10 == 0, -1).otherwise(1))
    table = f"file://{tmp_path}/counts"
    q = ST.keep_counts(signed, table, ["event_type"], f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["event_type"]: r["count"] for r in spark.read.parquet(f"{table}/v=0").collect()}
    want = {r["event_type"]: r["n"] for r in events.groupBy("event_type").agg(F.sum(F.when(F.col("event_id") % 10 == 0, -1).otherwise(1)).alias("n")).collect()}
    assert got == want


def plain_outbox(files, fails, attempts=5):
    """Outcomes file by file: (event, attempts, outcome), in the order in which each share sees them."""
    state, out, clock = {}, [], 0
    for rows, top in files:
        now = clock
        for share, event, generation, kind in rows:
            if kind == "event":
                state.setdefault((share, event), {"generation": generation, "tries": 0, "due": 0, "at": "pending"})
            elif kind == "retry":
                for (s, e), x in state.items():
                    if s == share and x["at"] == "dead" and event in (None, e):
                        x.update(tries=0, at="pending", due=now)
        for (share, event), x in sorted(state.items(), key=lambda i: (i[0][0], i[1]["generation"], i[0][1])):
            if x["at"] == "pending" and x["due"] <= now:
                x["tries"] += 1
                x["at"] = "handled" if x["tries"] > fails(event) else "dead" if x["tries"] >= attempts else "pending"
                x["due"] = now + SF.backoff_ms(x["tries"])
                out.append((share, event, x["tries"], "retry" if x["at"] == "pending" else x["at"]))
        clock = max(clock, top)
    return out


def fails(event):
    return int(event[1:]) % 7


def test_outbox(spark, tmp_path):
    """Every event is handled once, by generation, or dead after five failures, across a restart; dead letters can be tried again."""
    r = random.Random(3)
    hour, start = 3_600_000, 1_700_000_000_000
    files, n = [], 0
    for k in range(14):
        rows = [(r.choice("abc"), f"e{n + i}", r.randrange(1000), "event") for i in range(12 if k < 4 else 0)]
        n += len(rows)
        rows += [x for x in rows[:2]] + [(s, None, 0, "tick") for s in "abc"]  # delivered twice: once
        if k == 10:
            rows.append(("a", None, 0, "retry"))
        files.append((rows, start + k * 7 * hour))
    schema = "share string, event_id string, generation long, created_at long, payload string, kind string, clock long"

    def put(part):
        for k, (rows, top) in part:
            frame = spark.createDataFrame([(s, e, g, 0, "p", kind, top) for s, e, g, kind in rows], schema).withColumn("clock", F.timestamp_millis("clock"))
            frame.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def run():
        handle = lambda events: [a + 1 > fails(e) for e, a in zip(events["event_id"], events["attempts"])]
        live = spark.readStream.schema(SF.OUTBOX_ROWS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        with SF.timer_state(spark):
            SF.outbox(live, handle).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    numbered = list(enumerate(files))
    put(numbered[:3])
    run()
    put(numbered[3:])
    run()
    got = [tuple(x) for x in spark.read.parquet(f"file://{tmp_path}/out").select("share", "event_id", "attempts", "outcome", "generation").collect()]
    final = {}
    for share, event, tries, outcome, _ in got:
        assert outcome == "retry" or outcome == "handled" and (share, event) not in {k for k, v in final.items() if v[1] == "handled"} or outcome == "dead"
        if outcome != "retry":
            final.setdefault((share, event), (tries, outcome))
    assert len({e for _, e in final}) == n and Counter(x[3] for x in got)["handled"] == sum(fails(f"e{i}") < 5 for i in range(n))
    want = {}
    for share, event, tries, outcome in plain_outbox(files, fails):
        if outcome != "retry":
            want.setdefault((share, event), (tries, outcome))
    assert final == want
    dead_a = {e for (s, e), v in final.items() if v[1] == "dead" and s == "a"}
    assert {e for s, e, tries, o, _ in got if s == "a" and fails(e) >= 5 and tries == 1} == dead_a and Counter(e for s, e, t, o, _ in got if e in dead_a and t == 1) == {e: 2 for e in dead_a}


def test_outbox_order(spark, tmp_path):
    rows = [("s", f"e{g * 7}", g, 0, "p", "event") for g in (5, 3, 9, 1, 7)]
    spark.createDataFrame(rows, "share string, event_id string, generation long, created_at long, payload string, kind string").withColumn("clock", F.lit("2024-01-01").cast("timestamp")).repartition(3).write.parquet(f"file://{tmp_path}/in")
    seen = f"{tmp_path}/seen"

    def handle(events):
        with open(seen, "a") as f:
            f.writelines(f"{g}\n" for g in events["generation"])
        return [True] * len(events)

    live = spark.readStream.schema(SF.OUTBOX_ROWS).parquet(f"file://{tmp_path}/in")
    with SF.timer_state(spark):
        assert drain(SF.outbox(live, handle), spark, name="outbox").count() == 5
    assert open(seen).read().split() == ["1", "3", "5", "7", "9"]


def test_leases(spark, tmp_path):
    """Stream and batch agree on which leases live; retention leaves what they pin."""
    r = random.Random(5)
    start, rows = dt.datetime(2024, 1, 1), []
    for k in range(6):
        clock = start + dt.timedelta(hours=k)
        part = [(f"s{r.randrange(4)}", f"t{r.randrange(9)}", r.choice(["take", "take", "release"]), clock + dt.timedelta(minutes=r.randrange(20, 240)), clock + dt.timedelta(seconds=i)) for i in range(8)]
        rows += part
        spark.createDataFrame(part, SF.LEASE_ROWS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    live = spark.readStream.schema(SF.LEASE_ROWS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    with SF.timer_state(spark):
        ended = [tuple(x)[:3] for x in drain(SF.lease_ends(live), spark, name="leases").collect()]
    batch = spark.createDataFrame(rows, SF.LEASE_ROWS)
    now = max(x[4] for x in rows)
    want = {tuple(x)[:2] for x in SF.live_leases(batch, F.lit(now)).collect()}
    taken, state = Counter(), {}
    for s, t, op, until, clock in rows:
        for key in [k for k, v in state.items() if v <= clock]:
            state.pop(key)
        if op == "take":
            taken[s, t] += (s, t) not in state
            state[s, t] = until
        elif (s, t) in state:
            state.pop((s, t))
    assert {k for k, v in state.items() if v > now} == want and want
    assert {(s, t) for s, t, _ in ended} >= set(taken) - want and all(e in ("released", "expired") for _, _, e in ended)
    snaps = spark.createDataFrame([("k", f"s{i}", i) for i in range(4)] + [("k", "x", -1)], "key string, snapshot_id string, created_at long")
    gone = {x["snapshot_id"] for x in SF.retirable(snaps, SF.live_leases(batch, F.lit(now)), 1).collect()}
    assert gone == {"x", "s0", "s1", "s2"} - {s for s, _ in want}


def test_lifecycle(spark, tmp_path):
    rows = spark.createDataFrame([("a", "complete", 1), ("a", "archive", 2), ("b", "reopen", 1), ("b", "expire", 2)], "id string, operation string, ts long")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/ops")
    live = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/ops")
    got = drain(ST.lifecycle_stream(live, {(s, o): n for s, o, n in LIFECYCLE}), spark, "update", "life")
    assert {r["id"]: (r["state"], r["rejected"]) for r in got.collect()} == {"a": ("archived", 0), "b": ("expired", 1)}


def test_digest_is_a_set(spark):
    c = spark.createDataFrame([("a", "added"), ("b", "removed")], "uri string, change string")
    assert ST.generation_digest("g", c).first() == ST.generation_digest("g", c.orderBy(F.desc("uri"))).first() != ST.generation_digest("h", c).first()
