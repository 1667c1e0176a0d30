"""Streaming queries, run over the files of a table until they are used up."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tarnlight.operators.relational import running
from tarnlight.plans.base import RECALL, Catalogue
from tarnlight.plans.catalog import recall
from tarnlight.session import checkpoint_folder, read
from tarnlight.streaming import capture

catalogue = Catalogue()
add = catalogue.add


def _place(spark) -> str:
    """A new folder that all executors share."""
    return os.path.join(checkpoint_folder(spark), f"stream-{uuid.uuid4().hex}")


def _input(spark, folder: str, table: str):
    """The table as a stream of its files; a table of one file is its own folder."""
    frame = read(spark, folder, table)
    path = f"{folder}/{table}.parquet"
    stream = spark.readStream.schema(frame.schema)
    return stream.parquet(path) if os.path.isdir(path) else stream.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


EVENTS = f"""SELECT lower(trim(session_id)) AS session, epoch_us(created_at)::DOUBLE / 1e6 AS ts, row_number() OVER w AS n, sum(length(coalesce(content, ''))) OVER w AS chars FROM {RECALL}
 WHERE session_id IS NOT NULL AND created_at IS NOT NULL WINDOW w AS (PARTITION BY lower(trim(session_id)) ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)"""


def gate_sql(first: str, later: str) -> str:
    """A gate per session, event by event: ``first`` and ``later`` tell when it opens, of an event ``e`` and the state ``g``."""
    return f"""WITH RECURSIVE e AS MATERIALIZED ({EVENTS}), g AS (
 SELECT session, 0::BIGINT AS n, NULL::DOUBLE AS last_ts, 0::BIGINT AS last_turns, 0::HUGEINT AS last_chars, 0 AS opened FROM e WHERE n = 1
 UNION ALL SELECT session, n, CASE WHEN o THEN ts ELSE last_ts END, CASE WHEN o THEN n ELSE last_turns END, CASE WHEN o THEN chars ELSE last_chars END, opened + o::INT
 FROM (SELECT g.session, e.n, e.ts, e.chars, g.last_ts, g.last_turns, g.last_chars, g.opened, CASE WHEN g.last_ts IS NULL THEN {first} ELSE {later} END AS o FROM g JOIN e ON e.session = g.session AND e.n = g.n + 1))
 SELECT session, max(opened)::BIGINT AS opened, max(n) AS events FROM g GROUP BY 1"""


def messages_in_time(spark, folder):
    """``(session, ts, id, length)`` of every message with a session and a time, ids being written alike."""
    r = recall(spark, folder).where("created_at is not null and session_id is not null")
    ts = F.unix_micros(F.col("created_at").cast("timestamp")).cast("double") / 1e6
    return r.select(F.lower(F.trim("session_id")).alias("session"), ts.alias("ts"), "id", F.length(F.coalesce("content", F.lit(""))).cast("long").alias("length"))


@add("R1", gate_sql("e.n >= 4 AND e.chars >= 800", "e.ts - g.last_ts >= 600 OR (e.n - g.last_turns >= 4 AND e.chars - g.last_chars >= 800)"))
def session_gates(spark, folder):
    """The gate of every session, event by event, as a stateful stream; turns and characters are counted from the session's start."""
    events = running(messages_in_time(spark, folder), "session", ["ts", "id"], {"turns": F.lit(1).cast("long"), "chars": F.col("length")}).select("session", "ts", "turns", "chars")
    gates = capture.run_in_order(events, capture.session_gate, _place(spark))
    return gates.groupBy("session").agg(F.count_if("opened").alias("opened"), F.count("*").alias("events"))


def timed(spark, folder, seconds):
    events = messages_in_time(spark, folder).select("session", "ts")
    gates = capture.run_in_order(events, lambda stream: capture.time_gate(stream, seconds), _place(spark))
    return gates.groupBy("session").agg(F.count_if("opened").alias("opened"), F.count("*").alias("events"))


@add("R2", gate_sql("true", "e.ts - g.last_ts >= 300"))
def locks(spark, folder):
    """A lock per session that is taken by a message if it is free, and falls free 300 seconds after it was taken."""
    return timed(spark, folder, 300)


@add("R5", gate_sql("true", "e.ts - g.last_ts >= 600"))
def thread_gates(spark, folder):
    return timed(spark, folder, 600)


@add("R3", "SELECT DISTINCT id, role FROM memory_recall")
@add("R9", "SELECT DISTINCT id, role FROM memory_recall")
def captured_once(spark, folder):
    """Every message written once, though rows arrive twice."""
    place = _place(spark)
    stream = _input(spark, folder, "memory_recall").select("id", "role")
    capture.append_once(stream, f"{place}/out", f"{place}/mark", ["id"]).awaitTermination()
    return spark.read.parquet(f"{place}/out")


@add("R8", f"SELECT lower(trim(role)) AS role, count(*) AS n, count(tool_calls) AS with_calls FROM {RECALL} GROUP BY 1")
def optional_fields(spark, folder):
    return recall(spark, folder).groupBy(F.lower(F.trim("role")).alias("role")).agg(F.count("*").alias("n"), F.count("tool_calls").alias("with_calls"))


@add("S17", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def written_and_read(spark, folder):
    """A sink: rows appended to a table of Parquet files and read again."""
    from tarnlight.sources.files import append_rows

    place = _place(spark)
    append_rows(read(spark, folder, "events").select("event_id", "event_type"), f"{place}/events")
    return spark.read.parquet(f"{place}/events").groupBy("event_type").agg(F.count("*").alias("n"))
