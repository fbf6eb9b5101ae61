"""Live run status and daily run counts with Structured Streaming.

Both keep state that the watermark bounds: a day's count until the day is over for good, a run's status until nothing has
been heard of it for a time limit.  What comes later than the watermark is dropped.  Changes go to a folder of batches that
a restart or a repeated batch leaves as it was (``upsert``), and ``current`` reads the newest row of each key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Parts that runs are dealt over by a hash: a call of Python and a state for each part, as one for each run takes most of the time.
PARTS = 256
STATUS = "user_id long, status string, ts timestamp, event_id long, is_live boolean"


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day_start, event_type, runs): tumbling days of events (ts, event_type), for append or update mode.

    An event is dropped if its day ended ``late`` before the latest event of the batches before; a null time is dropped too.
    """
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("runs"))
    return counts.select(F.col("window.start").alias("day_start"), "event_type", "runs")


def latest_status(events: DataFrame, late: str = "1 day", silent: str = "10 days") -> DataFrame:
    """(user_id, status, ts, event_id, is_live): each run's newest event of (user_id, event_type, ts, event_id), for update mode.

    A row is given when a newer event of the run comes, and once more with ``is_live`` false when the watermark is past its
    newest event by more than ``silent``; the run is then forgotten until its next event.  Events older than the watermark
    are dropped.  Of equal times the larger event_id is newer.  Runs are dealt over parts, whose state holds each run's newest
    event; a part's time limit is that of its oldest.
    """
    limit = int(pd.Timedelta(silent).total_seconds() * 1000)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {user: (status, us, event) for user, status, us, event in json.loads(state.get[0])} if state.exists else {}
        came: dict[int, tuple] = {}
        if not state.hasTimedOut:
            for frame in frames:
                newest = frame.sort_values(["us", "event_id"]).drop_duplicates("user_id", keep="last")
                for user, status, us, event in zip(newest["user_id"].tolist(), newest["event_type"], newest["us"].tolist(), newest["event_id"].tolist(), strict=True):
                    best = came.get(user, known.get(user))
                    came[user] = (None if pd.isna(status) else status, us, event) if best is None or (us, event) > best[1:] else best
        rows = [(user, *best, True) for user, best in came.items() if best != known.get(user)]
        mark = state.getCurrentWatermarkMs()
        silent_ones = [user for user, best in known.items() if user not in came and best[1] // 1000 + limit < mark]
        rows += [(user, *known.pop(user), False) for user in silent_ones]
        known |= came
        if known:
            state.update((json.dumps([(user, *best) for user, best in known.items()]),))
            state.setTimeoutTimestamp(min(best[1] for best in known.values()) // 1000 + limit)
        elif state.exists:
            state.remove()
        if rows:
            out = pd.DataFrame(rows, columns=["user_id", "status", "ts", "event_id", "is_live"])
            yield out.assign(ts=pd.to_datetime(out["ts"], unit="us"))

    timed = events.where("ts IS NOT NULL AND user_id IS NOT NULL").withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    dealt = timed.withColumn("user_id", F.col("user_id").cast("long")).withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(PARTS)))
    return dealt.groupBy("part").applyInPandasWithState(follow, STATUS, "known string", "update", GroupStateTimeout.EventTimeTimeout)


def upsert(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: each batch is a folder of its own, which the same batch replaces if it runs again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def current(spark: SparkSession, folder: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The newest row of each key that ``upsert`` has put in a folder."""
    rows = spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/batch=*")
    rest = [c for c in schema.names if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1).cast("long")).alias("newest"))
    return newest.select(*(F.col(c) if c in keys else F.col(f"newest.{c}").alias(c) for c in schema.names))


def follow(out: DataFrame, folder: str, state: str) -> StreamingQuery:
    """Runs a stream over what has come so far, in update mode, into a folder of batches; ``state`` lets a later run go on."""
    return out.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(upsert(folder)).start()
