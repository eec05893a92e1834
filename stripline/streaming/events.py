"""The processing log as a stream: incremental reading, appending, state transitions and job durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stripline.operators.blocks import neighbours, range_blocks, running
from stripline.session import cut
from stripline.streaming.tail import RANGE_BYTES, tail

EVENT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("chapter", T.StringType()),
    T.StructField("request_id", T.StringType()), T.StructField("event", T.StringType()), T.StructField("state", T.StringType()), T.StructField("props", T.StringType()),
])


def log_stream(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A JSON-lines log that grows, one file or the files of a folder, as a stream with a declared schema."""
    return tail(spark, path, range_bytes).select(F.from_json("value", EVENT).alias("e")).select("e.*")


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """JSON-lines log of files that never change, as a stream with a declared schema; see :func:`log_stream` for files that grow."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet file of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def event_append(events: DataFrame, path: str, checkpoint: str):
    """Streaming query that appends events to the JSON-lines log; exactly once through its checkpoint."""
    return events.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transitions(log: DataFrame) -> DataFrame:
    """Rows where a chapter's state differs from the one before, in event order; ordered ranges, not one task per chapter."""
    e = log.select("chapter", "ts", "event_id", "state")
    n = running(range_blocks(e, ["chapter"], ["ts", "event_id"]), ["chapter"], ["ts", "event_id"], number="_n").drop("_b")
    d = neighbours(n, ["chapter"], "_n", {"state_before": "state"})
    return d.filter(F.col("state_before") != F.col("state")).select("chapter", "ts", "event_id", "state_before", F.col("state").alias("state_after"))


class _Transitions(StatefulProcessor):
    """The last event of a chapter; rows of a trigger are put in event order and compared with it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts long, event_id long, state string")

    def handleInputRows(self, key, rows, timerValues):
        had = self.last.get() if self.last.exists() else None
        last, before = ((had[0], had[1]), had[2]) if had else (None, None)
        found = [(r.us, r.event_id, r.state) for r in rows]
        found.sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1] is not None, e[1] or 0))
        repeated = None
        for ts, event_id, state in found:
            at = (ts, event_id)
            if at == repeated:
                continue
            if None in at or (had and at <= (had[0], had[1])):
                yield Row(chapter=key[0], us=ts, event_id=event_id, state_before=None, state_after=state, late=True)
            else:
                if last is not None and before is not None and state is not None and before != state:
                    yield Row(chapter=key[0], us=ts, event_id=event_id, state_before=before, state_after=state, late=False)
                last, before = at, state
            repeated = at
        if last is not None and (not had or last != (had[0], had[1])):
            self.last.update((last[0], last[1], before))

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """Streams that start from here on keep their state in RocksDB, which state by key needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def transition_stream(events: DataFrame, root: str, checkpoint: str):
    """Streaming transitions, written to ``root`` by ``late``: the state by chapter is its last event, so a trigger's work follows its own rows.

    An event that is not after its chapter's last state of the triggers before, or that has no time or number, is late: it changes nothing and goes to
    ``late=true`` with its state as ``state_after``.  Events repeated within a trigger count once.  The rows of a chapter in one trigger are sorted in
    one task, so the trigger bounds them.
    """
    keyed_state(events.sparkSession)
    e = events.select("chapter", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "state")
    out = e.groupBy("chapter").transformWithState(
        _Transitions(), "chapter string, us long, event_id long, state_before string, state_after string, late boolean", "Append", "None")
    rows = out.select("chapter", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "event_id", "state_before", "state_after", "late")
    return rows.writeStream.partitionBy("late").format("parquet").option("path", root).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_transitions(spark: SparkSession, root: str) -> DataFrame:
    """What :func:`transition_stream` has written, late events (``late``) included."""
    return spark.read.parquet(root).withColumn("late", F.col("late").cast("boolean"))


def _duration(grouped) -> DataFrame:
    def at(f, *names):
        return f(F.when(F.col("event").isin(*names), F.col("ts")))

    d = grouped.agg(
        at(F.min, "job_requested").alias("requested_at"), at(F.min, "job_started").alias("started_at"),
        at(F.max, "job_finished", "job_failed").alias("ended_at"), F.max(F.when(F.col("event") == "job_failed", 1).otherwise(0)).alias("failed"))
    return d.withColumns({"failed": F.col("failed") == 1, "duration_ms": F.expr("timestampdiff(MICROSECOND, started_at, ended_at)") / 1000.0})


def job_durations(log: DataFrame) -> DataFrame:
    """Requested, started and ended times of every request, and its duration; repeated events change nothing."""
    return _duration(log.groupBy("request_id"))


def job_durations_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The same over a stream, in append mode: a request's row comes, and its state goes, once the watermark is ``delay`` past its last event.

    A request is a session: its events follow within ``delay``, also across midnight; one that is further from the others begins another session.  The
    watermark is ``delay`` behind the latest event; what is later than it is left out, as are events without a time.  An event that comes again within
    that time counts once.
    """
    keyed_state(events.sparkSession)
    e = events.filter("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    d = _duration(e.groupBy(F.session_window("ts", delay), "request_id"))
    at = {c: F.col(c).cast("timestamp_ntz") for c in ("requested_at", "started_at", "ended_at")}
    return d.withColumns(at).select("request_id", *at, "failed", "duration_ms")


def latest_batch(files: DataFrame, seconds: int = 12, at: str = "mtime") -> DataFrame:
    """Files written within ``seconds`` of the newest one."""
    newest = files.agg(F.max(at)).scalar()
    return files.filter(F.col(at) >= newest - F.expr(f"interval {seconds} seconds"))


def nested_search(reports: DataFrame, body: str, term: str, keys: list[str]) -> DataFrame:
    """Paths of nested JSON reports where a key or a string value holds ``term``, whatever its case, at any depth.

    ``value`` is the key or the string.  Each level is written once and opened from there; there are as many rounds as the deepest report has levels.
    """
    spark = reports.sparkSession
    holds = lambda c: F.contains(F.lower(c), F.lit(term.lower()))
    level = cut(reports.select(*keys, F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.col(body).alias("json")))
    hits = level.limit(0).select(*keys, "path", F.col("name").alias("value"))
    while not level.isEmpty():
        v = level.withColumn("v", F.try_parse_json("json"))
        kind = F.schema_of_variant("v")
        named = v.filter(holds("name")).select(*keys, "path", F.col("name").alias("value"))
        text = v.filter(kind == "STRING").select(*keys, "path", F.try_variant_get("v", "$", "string").alias("value")).filter(holds("value"))
        hits = hits.unionByName(named).unionByName(text)
        inner = v.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        child = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.coalesce(F.concat(F.lit("."), F.col("key")), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = cut(child.select(*keys, F.concat("path", step).alias("path"), F.col("key").alias("name"), F.to_json("value").alias("json")))
    return hits
