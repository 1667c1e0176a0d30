"""Incremental capture: gates per session, unseen suffixes, suppressed repeats, and an idempotent sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tarnlight.session import cut

GATE_STATE = "last_ts double, last_turns long, last_chars long"
GATE_OUT = "session string, ts double, turns long, chars long, opened boolean"
TURNS, CHARS, SECONDS = 4, 800, 600
#: Events of a slice of time that is worked off at once.
SLICE = 2_000_000


def gate_opens(first: bool, elapsed: float, new_turns: int, growth: int, turns: int = TURNS, chars: int = CHARS, seconds: float = SECONDS) -> bool:
    """Whether a session is due: at first by turns and growth; later by time alone, or again by turns and growth."""
    grown = new_turns >= turns and growth >= chars
    return grown if first else elapsed >= seconds or grown


def _gate(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
    import pandas as pd

    last_ts, turns0, chars0 = state.get if state.exists else (-1.0, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "turns"])
    out = []
    for row in rows.itertuples():
        opened = gate_opens(last_ts < 0, row.ts - last_ts, int(row.turns - turns0), int(row.chars - chars0))
        if opened:
            last_ts, turns0, chars0 = float(row.ts), int(row.turns), int(row.chars)
        out.append((key[0], float(row.ts), int(row.turns), int(row.chars), opened))
    state.update((last_ts, turns0, chars0))
    yield pd.DataFrame(out, columns=["session", "ts", "turns", "chars", "opened"])


def session_gate(events: DataFrame) -> DataFrame:
    """Events ``session, ts, turns, chars`` of a stream with ``opened``: whether the event opened the session's gate.

    The state of a session is three numbers. It is tested when an event arrives, not by a clock.
    """
    return events.groupBy("session").applyInPandasWithState(_gate, GATE_OUT, GATE_STATE, "append", GroupStateTimeout.NoTimeout)


def time_gate(events: DataFrame, seconds: float) -> DataFrame:
    """Events ``session, ts`` of a stream with ``opened``: whether so many seconds have passed since the session last opened."""

    def gate(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        (last,) = state.get if state.exists else (None,)
        out = []
        for ts in sorted(t for b in batches for t in b["ts"]):
            opened = last is None or ts - last >= seconds
            last = float(ts) if opened else last
            out.append((key[0], float(ts), opened))
        state.update((last,))
        yield pd.DataFrame(out, columns=["session", "ts", "opened"])

    return events.groupBy("session").applyInPandasWithState(gate, "session string, ts double, opened boolean", "last double", "append", GroupStateTimeout.NoTimeout)


def slices(events: DataFrame, column: str, most: int) -> list[tuple]:
    """``(from, to)`` of stretches of a column, in order, with about ``most`` rows each; None where a stretch is open."""
    n = events.count()
    count = max(1, -(-n // most))
    marks = events.agg(F.percentile_approx(column, [i / count for i in range(1, count)], 10_000)).first()[0] if count > 1 else []
    marks = sorted(set(marks))
    return list(zip([None, *marks], [*marks, None]))


def run_in_order(events: DataFrame, gate: Callable[[DataFrame], DataFrame], place: str, most: int = SLICE) -> DataFrame:
    """The output of a gate over ``events``, which arrive by slices of time and are worked off one after the other.

    The state of a session lives on from slice to slice, so a session may be of any length: what one task holds of it
    is its share of a slice. A run that is broken off goes on from its checkpoint.
    """
    spark, events = events.sparkSession, cut(events)
    for low, high in slices(events, "ts", most):
        part = events if low is None else events.where(F.col("ts") >= low)
        (part if high is None else part.where(F.col("ts") < high)).write.mode("append").parquet(f"{place}/in")
        stream = gate(read_messages(spark, f"{place}/in", events.schema, 100_000))
        sink = stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/mark").option("path", f"{place}/out")
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def watch_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files that appear below a folder, ready to be ingested batch by batch."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("checksum"), "content")


def new_messages(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Messages of a stream, each id once within the delay; the watermark bounds the state."""
    return messages.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])


def counts_by_window(messages: DataFrame, length: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Messages per role and window of time; late ones count within the delay."""
    return messages.withWatermark("created_at", delay).groupBy(F.window("created_at", length), "role").agg(F.count("*").alias("n"))


def append_once(stream: DataFrame, table: str, checkpoint: str, keys: list[str]):
    """Write each batch's unseen rows to a Parquet folder, once, and stop when the input is used up.

    A batch that is tried again finds its rows in the folder and adds none; the offset is committed only after the write.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            seen = spark.read.parquet(table).select(*keys)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            fresh = fresh.join(seen, keys, "left_anti")
        fresh.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_messages(spark: SparkSession, folder: str, schema: str | StructType, files_each: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)
