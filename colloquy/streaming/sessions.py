"""Live sessions with Structured Streaming: windows of recent turns, alerts with a cool-down, run counts.

State is kept per session by ``transformWithStateInPandas`` (RocksDB state store) and goes with a session that is silent for TTL; within a micro-batch rows
are handled in order of time and event id, and what arrives after the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

KEEP, LIMIT = 20, 2000
#: Characters kept of a tool's output, and what stands before it.
TOOL_LIMIT, TOOL_MARK = 1000, "[tool:{}] "
#: How long a session's state is kept after it was last written.
TTL = timedelta(days=1)


def event_stream(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """(session, event_id, ts, kind, value) from a folder of event files."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.select(F.col("user_id").alias("session"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value").withWatermark("ts", late)


def _ms(ttl: timedelta | None) -> int | None:
    return None if ttl is None else int(ttl.total_seconds() * 1000)


def _with_state(rows: DataFrame, processor: StatefulProcessor, schema: StructType, ttl: timedelta | None) -> DataFrame:
    """State that ends asks for processing time, under which Spark looks for ended state in batch after batch: a query that is to stop
    when its input is used up must have no ``ttl``."""
    return rows.groupBy("session").transformWithStateInPandas(processor, schema, "append", "None" if ttl is None else "ProcessingTime")


class RecentTurns(StatefulProcessor):
    """Keeps a session's last KEEP interactions and emits them, renumbered, at each stop event. The output of a tool is
    cut shorter and marked with the tool's name. A session's turns go when nothing has come for the time of ``ttl``."""

    def __init__(self, stop: str, ttl: timedelta | None = TTL):
        self.stop, self.ttl = stop, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField("event_id", LongType()), StructField("speaker", StringType()), StructField("text", StringType())]
        self.turns = handle.getListState("turns", StructType(fields), _ms(self.ttl))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(a), b, c) for a, b, c in self.turns.get()] if self.turns.exists() else []
        out = []
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        own = lambda c: frame[c] if c in frame.columns else [None] * len(frame)
        for event_id, kind, text, speaker, tool in zip(frame["event_id"], frame["kind"], frame["text"], own("speaker"), own("tool")):
            text = "" if text is None else str(text)
            said = text[:LIMIT] if tool is None or pd.isna(tool) else TOOL_MARK.format(tool) + text[:TOOL_LIMIT]
            held = [*held, (int(event_id), speaker or "assistant", said)][-KEEP:]
            if kind == self.stop and len(held) >= 2:
                out += [(int(key[0]), int(event_id), i, s, t) for i, (_, s, t) in enumerate(held, 1)]
        self.turns.put(held)
        yield pd.DataFrame(out, columns=["session", "stop_id", "turn_number", "speaker", "raw_text"])

    def close(self) -> None:
        pass


def session_turns(events: DataFrame, stop: str, ttl: timedelta | None = TTL) -> DataFrame:
    """(session, stop_id, turn_number, speaker, raw_text) of a stream (session, event_id, ts, kind, text), which may have speaker and tool
    (the name of a tool whose output the text is) too."""
    fields = [StructField("session", LongType()), StructField("stop_id", LongType()), StructField("turn_number", IntegerType()), StructField("speaker", StringType()), StructField("raw_text", StringType())]
    return _with_state(events, RecentTurns(stop, ttl), StructType(fields), ttl)


def evaluate_at_stops(events: DataFrame, stop: str, evaluate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, ttl: timedelta | None = TTL, once: bool = False):
    """Starts a query that runs batch operators on a session's recent turns at each of its stop events.

    ``evaluate`` takes turns (conv_id, turn_number, speaker, raw_text), where conv_id is ``session:stop_id``, and returns rows with that conv_id,
    such as findings or a report. With ``once``, the query ends with its input. A micro-batch's rows go to a folder of their own, which a repeated batch replaces: none is written twice."""

    def write(turns: DataFrame, batch: int) -> None:
        turns = turns.withColumn("conv_id", F.concat_ws(":", "session", "stop_id")).select("conv_id", "turn_number", "speaker", "raw_text").persist()
        try:
            evaluate(turns).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        finally:
            turns.unpersist()

    writer = session_turns(events, stop, None if once else ttl).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Cooldown(StatefulProcessor):
    """Passes an alert unless the same type passed within the last ``gap`` interactions of the session;
    a change of ``root`` forgets what passed."""

    def __init__(self, gap: int, ttl: timedelta | None = TTL):
        self.gap, self.ttl = gap, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.passed = handle.getMapState("passed", StructType([StructField("kind", StringType())]), StructType([StructField("at", LongType())]), _ms(self.ttl))
        self.at = handle.getValueState("at", StructType([StructField("n", LongType()), StructField("root", StringType())]), _ms(self.ttl))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, root = self.at.get() if self.at.exists() else (0, None)
        passed = {k[0]: v[0] for k, v in self.passed.iterator()}
        out = []
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for event_id, kind, value, own in zip(frame["event_id"], frame["kind"], frame["value"], frame["root"]):
            n += 1
            if root is not None and own != root:
                passed = {}
            root = own
            if kind not in passed or n - passed[kind] >= self.gap:
                passed[kind] = n
                out.append((int(key[0]), int(event_id), kind, float(value)))
        self.passed.clear()
        for k, v in passed.items():
            self.passed.updateValue((k,), (int(v),))
        self.at.update((int(n), root))
        yield pd.DataFrame(out, columns=["session", "event_id", "kind", "value"])

    def close(self) -> None:
        pass


def alert_cooldown(alerts: DataFrame, gap: int = 5, ttl: timedelta | None = TTL) -> DataFrame:
    """Alerts (session, event_id, ts, kind, value, root) without repeats of a type within ``gap`` interactions."""
    schema = StructType([StructField("session", LongType()), StructField("event_id", LongType()), StructField("kind", StringType()), StructField("value", DoubleType())])
    return _with_state(alerts, Cooldown(gap, ttl), schema, ttl)


class RateLimit(StatefulProcessor):
    """Passes an entry of a session if the last that passed is ``seconds`` back or more, and at most ``most`` of them."""

    def __init__(self, seconds: float, most: int, ttl: timedelta | None = TTL):
        self.seconds, self.most, self.ttl = seconds, most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("last", DoubleType()), StructField("n", LongType())]), _ms(self.ttl))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.state.get() if self.state.exists() else (None, 0)
        out = []
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for event_id, ts in zip(frame["event_id"], frame["ts"]):
            at = ts.timestamp()
            if n < self.most and (last is None or at - last >= self.seconds):
                last, n = at, n + 1
                out.append((int(key[0]), int(event_id)))
        if n:
            self.state.update((float(last), int(n)))
        yield pd.DataFrame(out, columns=["session", "event_id"])

    def close(self) -> None:
        pass


def memory_rate_limit(entries: DataFrame, seconds: float = 60.0, most: int = 10, ttl: timedelta | None = TTL) -> DataFrame:
    """(session, event_id) of the entries of a stream (session, event_id, ts) that may be kept: a pause between them, and so many a session."""
    schema = StructType([StructField("session", LongType()), StructField("event_id", LongType())])
    return _with_state(entries, RateLimit(seconds, most, ttl), schema, ttl)


def distinct_alerts(alerts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of alerts (session, event_id, ts, ..) without repeats of an event that come within the watermark."""
    return alerts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "event_id"])


def detector_counts(findings: DataFrame, size: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, detector_name, n, mean): findings (ts, detector_name, confidence) by window, tumbling or sliding, and detector."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = findings.groupBy(window.alias("w"), "detector_name").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))
    return rows.select(F.col("w.start").alias("start"), "detector_name", "n", "mean")


def last_runs(runs: DataFrame, most: int = 100, within: str = "5 minutes") -> DataFrame:
    """(total, errors, mean, mean_ok) of the last ``most`` runs (event_id, ts, kind, value) that are no older than ``within`` of the
    newest; means are rounded down, 0 without a run."""
    newest = runs.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)
    rows = newest.join(newest.agg(F.max("ts").alias("_now"))).where(F.col("ts") >= F.col("_now") - F.expr(f"INTERVAL '{within.split()[0]}' MINUTE"))  # one row
    whole = lambda x: F.coalesce(F.floor(F.avg(x)), F.lit(0))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("kind") == "error").alias("errors"), whole(F.col("value")).alias("mean"), whole(F.when(F.col("kind") != "error", F.col("value"))).alias("mean_ok"))


def recent_runs(events: DataFrame, size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Per window: runs, errors and mean value, of all and of those that went well."""
    ok = F.col("kind") != "error"
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.groupBy(window.alias("w")).agg(F.count("*").alias("runs"), F.count_if(~ok).alias("errors"), F.avg("value").alias("mean"), F.avg(F.when(ok, F.col("value"))).alias("mean_ok"))
    return rows.select(F.col("w.start").alias("start"), "runs", "errors", F.round("mean", 6).alias("mean"), F.round("mean_ok", 6).alias("mean_ok"))


def session_counts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Events by session window and kind."""
    rows = events.groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, checkpoint: str, name: str, mode: str = "append") -> DataFrame:
    """Plays all available input through a stream and returns what it wrote."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
