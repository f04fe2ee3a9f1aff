"""State processors replayed over several batches, with late rows and expired keys, against plain folds."""

import datetime
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolex.streaming import events as S
from chronolex.streaming import stateful as T

START = 1_704_067_200_000  # 2024-01-01
LATE = T.HOUR


def batches(seed):
    """Six batches of events, each a day on; some rows come days late, some keys end early."""
    rng, out, number = random.Random(seed), [], 0
    for day in range(6):
        rows = []
        for _ in range(60):
            user = rng.randrange(3 if day > 2 else 6)
            at = START + day * T.DAY + rng.randrange(T.DAY) - (rng.choice([2, 3]) * T.DAY if day > 2 and rng.random() < 0.15 else 0)
            rows.append((number, at, user, rng.choice(["click", "view", "purchase", "signup", "error"]), round(rng.uniform(0, 90), 2), f'{{"k": {rng.randrange(9)}}}'))
            number += 1
        out.append(rows)
    return out


def replay(spark, days, keys, processor, schema, change=lambda df: df):
    folder = tempfile.mkdtemp(prefix="spark-")
    for k, rows in enumerate(days):
        frame = pd.DataFrame(rows, columns=["event_id", "ms", "user_id", "event_type", "value", "props"])
        frame["ts"] = pd.to_datetime(frame.pop("ms"), unit="ms")
        spark.createDataFrame(frame).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(f"{folder}/b{k}")
    stream = spark.readStream.schema(S.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*").withColumn("ts", F.col("ts").cast("timestamp"))
    return T.run(change(stream), keys, processor, schema)


def accepted(days):
    """The rows that aren't late, and the last watermark: the newest row so far less an hour.

    A batch's rows are held against the watermark of the batch before it, its timers against its own.
    """
    before, mark, out = 0, 0, []
    for rows in days:
        out.append(([r for r in rows if r[1] > before], mark))
        before, mark = mark, max([mark, *(r[1] - LATE for r in rows)])
    return out, mark


@pytest.mark.parametrize("seed", [1, 2])
def test_retention(spark, seed):
    days = batches(seed)
    taken, mark = accepted(days)
    rows = [r for part, _ in taken for r in part]
    assert len(rows) < 360  # some are late
    out = replay(spark, days, ["user_id"], T.Retention(2 * T.DAY), T.Retention.schema)
    now = {r.user_id: (r.turns, r.last_id) for r in S.latest(out.where("kind = 'parent'").drop("kind", "purged"), ["user_id"]).collect()}
    audit = {r.user_id: r.n for r in out.where("kind = 'audit'").groupBy("user_id").agg(F.sum("purged").alias("n")).collect()}
    for user in {r[2] for r in rows}:
        kept = [r for r in rows if r[2] == user and r[1] + 2 * T.DAY > mark]
        assert now[user] == (len(kept), max(((r[1], r[0]) for r in kept), default=(0, None))[1])
        assert audit.get(user, 0) == sum(r[2] == user for r in rows) - len(kept)
    assert any(turns == 0 for turns, _ in now.values())  # a key whose turns have all expired


def test_registry(spark):
    days = batches(3)
    taken, mark = accepted(days)
    rows = [r for part, _ in taken for r in part]
    out = {r.user_id: r.active for r in S.latest(replay(spark, days, ["user_id"], T.Registry(T.DAY, 5), T.Registry.schema), ["user_id"]).collect()}
    for user in {r[2] for r in rows}:
        last = {}
        for r in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])):
            last[int(r[5].split(":")[1].rstrip("}")) % 5] = r
        alive = sorted(task for task, r in last.items() if r[3] in ("click", "view") and r[1] + T.DAY > mark)
        assert out[user] == ",".join(map(str, alive))


def test_chat_session(spark):
    days = [[r for r in sorted(rows, key=lambda r: r[1])] for rows in batches(4)[:3]]  # no late rows: batches follow each other
    out = {r.user_id: (r.state, r.answered) for r in S.latest(replay(spark, days, ["user_id"], T.ChatSession(3 * T.HOUR), T.ChatSession.schema), ["user_id"]).collect()}
    mark = accepted(days)[1]
    for user in {r[2] for rows in days for r in rows if r[3] != "click"}:
        state, since, answered = "idle", 0, 0
        for _, ms, _, kind, *_ in sorted((r for rows in days for r in rows if r[2] == user), key=lambda r: (r[1], r[0])):
            if kind == "purchase":
                if state == "pending" and ms - since <= 3 * T.HOUR:
                    state, answered = "complete", answered + 1
                elif state in ("pending", "stopped"):
                    state = "stopped"
            elif kind in T.ChatSession.KINDS:
                state, since = T.ChatSession.KINDS[kind], ms
        if state == "pending" and since + 3 * T.HOUR < mark:
            state = "stopped"
        assert out[user] == (state, answered)


def test_retry_budget(spark):
    days = [sorted(rows, key=lambda r: r[1]) for rows in batches(5)[:3]]
    budget = T.RetryBudget(overall=100.0)
    out = replay(spark, days, ["user_id", "day"], budget, T.RetryBudget.schema, lambda df: df.withColumn("day", F.to_date("ts")))
    got = {(r.user_id, r.day): (r.attempts, round(r.elapsed, 4), r.outcome) for r in S.latest(out, ["user_id", "day"]).collect()}
    want = {}
    for r in sorted((r for rows in days for r in rows if r[3] in ("error", "signup", "purchase")), key=lambda r: (r[1], r[0])):
        key = (r[2], (datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=r[1])).date())
        want[key] = budget.after(want.get(key, (0, 0.0, "open")), r[3], r[4])
    assert got == {k: (a, round(e, 4), o) for k, (a, e, o) in want.items()}
    assert {o for *_, o in got.values()} >= {"success", "refused", "exhausted"}


def test_budget_of_one_request():
    b = T.RetryBudget()
    assert b.after((0, 0.0, "open"), "purchase", 60) == (1, 55.0, "open")  # cut off, may be tried again
    assert b.after((2, 110.0, "open"), "error", 5) == (3, 115.0, "exhausted")
    assert b.after((1, 55.0, "success"), "error", 5) == (1, 55.0, "success")
    assert T.RetryBudget(most=9, overall=100).after((1, 55.0, "open"), "error", 50) == (2, 105.0, "too long")
