"""Streams with state: late rows, silence, restarts and repeated batches."""

from datetime import datetime

from pyspark.sql import functions as F

from flotsam.streaming import runs as live

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def put(spark, folder, rows):
    spark.createDataFrame([(i, ts and datetime.fromisoformat(ts), u, t) for i, ts, u, t in rows], SCHEMA).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(folder)


def run(spark, tmp_path, of, keys):
    out = of(stream(spark, f"{tmp_path}/in"))
    live.follow(out, f"{tmp_path}/rows", f"{tmp_path}/state").awaitTermination()
    return live.current(spark, f"{tmp_path}/rows", out.schema, keys)


FIRST = [(1, "2024-03-01 10:00", 1, "start"), (2, "2024-03-01 11:00", 1, "stop"), (3, "2024-03-04 09:00", 2, "start")]
LATER = [
    (4, "2024-03-01 12:00", 3, "start"),  # its day ended two days before the newest event: dropped
    (5, "2024-03-03 01:00", 1, "fail"),  # its day ended less than a day before the newest event
    (6, "2024-03-04 09:00", 2, "wait"),  # the same time, a larger id
    (7, "2024-03-20 00:00", 4, "start"),
]


def counts(rows):
    return {(str(r.day_start)[:10], r.event_type): r.runs for r in rows.collect()}


def test_days_drop_late_rows_and_go_on_after_a_restart(spark, tmp_path):
    of, keys = lambda events: live.daily_counts(events, "1 day"), ["day_start", "event_type"]
    put(spark, f"{tmp_path}/in", FIRST)
    first = {("2024-03-01", "start"): 1, ("2024-03-01", "stop"): 1, ("2024-03-04", "start"): 1}
    assert counts(run(spark, tmp_path, of, keys)) == first
    assert counts(run(spark, tmp_path, of, keys)) == first  # nothing new came
    put(spark, f"{tmp_path}/in", LATER)
    assert counts(run(spark, tmp_path, of, keys)) == first | {("2024-03-03", "fail"): 1, ("2024-03-04", "wait"): 1, ("2024-03-20", "start"): 1}


def test_days_in_append_mode_come_once_they_are_over(spark, tmp_path):
    put(spark, f"{tmp_path}/in", FIRST + LATER[3:])
    out = live.daily_counts(stream(spark, f"{tmp_path}/in"), "1 day")
    out.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(live.upsert(f"{tmp_path}/rows")).start().awaitTermination()
    assert counts(live.current(spark, f"{tmp_path}/rows", out.schema, ["day_start", "event_type"])) == {("2024-03-01", "start"): 1, ("2024-03-01", "stop"): 1, ("2024-03-04", "start"): 1}


def test_status_falls_silent_and_late_rows_change_nothing(spark, tmp_path):
    of = lambda events: live.latest_status(events, "1 day", "10 days")
    statuses = lambda rows: {r.user_id: (r.status, r.event_id, r.is_live) for r in rows.collect()}
    put(spark, f"{tmp_path}/in", FIRST + [(8, "2024-03-04 08:00", None, "start"), (9, None, 5, "start")])
    assert statuses(run(spark, tmp_path, of, ["user_id"])) == {1: ("stop", 2, True), 2: ("start", 3, True)}
    put(spark, f"{tmp_path}/in", LATER)
    want = {1: ("stop", 2, False), 2: ("wait", 6, False), 4: ("start", 7, True)}  # 5 is more than a day before 3
    assert statuses(run(spark, tmp_path, of, ["user_id"])) == want
    put(spark, f"{tmp_path}/in", [(10, "2024-03-20 05:00", 1, "start"), (11, "2024-03-18 23:00", 4, "stop")])
    assert statuses(run(spark, tmp_path, of, ["user_id"])) == want | {1: ("start", 10, True)}


def test_runs_share_a_state_by_parts_and_fall_silent_while_others_of_their_part_go_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "PARTS", 1)
    of = lambda events: live.latest_status(events, "1 day", "10 days")
    put(spark, f"{tmp_path}/in", [(k, "2024-03-01 10:00", k, "start") for k in range(1, 9)])
    run(spark, tmp_path, of, ["user_id"])
    for day in (14, 25, 26):
        put(spark, f"{tmp_path}/in", [(100 + day, f"2024-03-{day} 10:00", 8, None)])
        query = live.follow(of(stream(spark, f"{tmp_path}/in")), f"{tmp_path}/rows", f"{tmp_path}/state")
        query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    found = {r.user_id: (r.status, r.is_live) for r in live.current(spark, f"{tmp_path}/rows", of(stream(spark, f"{tmp_path}/in")).schema, ["user_id"]).collect()}
    assert found == {k: ("start", False) for k in range(1, 8)} | {8: (None, True)}


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, n long")
    put = live.upsert(str(tmp_path))
    put(rows, 0)
    put(rows.where("k = 1").withColumn("v", F.lit("c")), 1)
    for _ in range(2):
        put(rows.where("k = 1").withColumn("v", F.lit("d")), 10)
    assert {(r.k, r.v, r.n) for r in live.current(spark, str(tmp_path), rows.schema, ["k"]).collect()} == {(1, "d", 1), (2, "b", 1)}
