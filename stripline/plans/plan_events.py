"""Queries over the processing log, batch and streaming."""

import uuid

from pyspark.sql import functions as F

from stripline.plans import standins as S
from stripline.plans.registry import out, query, view
from stripline.session import shared_dir
from stripline.streaming import events as V
from stripline.streaming.tail import append_lines

view("t_trans", """select chapter, ts, event_id, b state_before, state state_after from (select *, lag(state) over (partition by chapter order by ts, event_id) b from t_log) x where b<>state""")


def fresh(spark):
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


@query("chapter_transitions", "select * from t_trans")
def chapter_transitions(spark, sf):
    return out(V.transitions(S.log(spark, sf)), "chapter", "ts", "event_id", "state_before", "state_after")


@query("chapter_transitions_stream", "select * from t_trans")
def chapter_transitions_stream(spark, sf):
    root = fresh(spark)
    V.transition_stream(S.log_of(V.table_stream(spark, sf, "events")), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return out(V.read_transitions(spark, f"{root}/out").filter("not late"), "chapter", "ts", "event_id", "state_before", "state_after")


view("t_jobs", """
select request_id, requested_at, started_at, ended_at, failed, (epoch_us(ended_at)-epoch_us(started_at))/1000 duration_ms from (
 select request_id, min(ts) filter (event='job_requested') requested_at, min(ts) filter (event='job_started') started_at, max(ts) filter (event in ('job_finished','job_failed')) ended_at, count(*) filter (event='job_failed')>0 failed from t_log group by request_id) x
""")


@query("job_durations", "select * from t_jobs")
def job_durations(spark, sf):
    return out(V.job_durations(S.log(spark, sf)), "request_id", "requested_at", "started_at", "ended_at", "failed", "duration_ms")


FILES = 4  # log files that grow side by side


def lines_of(log):
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return log.select(F.to_json(F.struct(*[f.name for f in V.EVENT]), {"timestampFormat": micros, "timestampNTZFormat": micros}).alias("value"))


@query("job_durations_stream", "select request_id, failed, duration_ms from t_jobs")
def job_durations_stream(spark, sf):
    """The log ends with a heartbeat four days after its last event, which closes all requests."""
    root, e = fresh(spark), S.log(spark, sf)
    folder = f"{root}/log"

    beat = e.agg((F.max("ts") + F.expr("interval 4 days")).alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), "ts", *[F.lit(None).cast("string").alias(c) for c in ("chapter", "request_id")], F.lit("heartbeat").alias("event"),
        *[F.lit(None).cast("string").alias(c) for c in ("state", "props")])
    append_lines(lines_of(e.unionByName(beat)), folder, FILES)
    d = V.job_durations_stream(V.log_stream(spark, folder))
    q = d.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").start()
    q.processAllAvailable()
    q.stop()
    return out(spark.read.parquet(f"{root}/out").filter("request_id is not null"), "request_id", "failed", "duration_ms")


@query("event_append", "select event_id, chapter, request_id, event, state from t_log")
def event_append(spark, sf):
    """The event table streamed into the log, and the log read back as a stream into a table."""
    root = fresh(spark)
    V.event_append(S.log_of(V.table_stream(spark, sf, "events")), f"{root}/log", f"{root}/c1").awaitTermination()
    return out(spark.read.schema(V.EVENT).json(f"{root}/log"), "event_id", "chapter", "request_id", "event", "state")


@query("event_stream", "select event, state, count(*) n from t_log group by all")
def event_stream(spark, sf):
    """Log files that grow between two runs of one stream."""
    root, e = fresh(spark), S.log(spark, sf)
    folder, sizes = f"{root}/log", None
    for half in (0, 1):
        sizes = append_lines(lines_of(e.filter(F.col("event_id") % 2 == half)), folder, FILES, sizes)
        s = V.log_stream(spark, folder)
        s.writeStream.format("parquet").option("path", f"{root}/table").option("checkpointLocation", f"{root}/c2").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/table").groupBy("event", "state").agg(F.count(F.lit(1)).alias("n"))


@query("latest_batch", "select event_id, chapter from t_log where ts >= (select max(ts) from t_log) - interval 86400 seconds")
def latest_batch(spark, sf):
    return out(V.latest_batch(S.log(spark, sf), 86400, "ts"), "event_id", "chapter")


@query("nested_search", """
select event_id, '$.job.deep.a.b.c.Finish_note' path, 'Finish_note' as value from t_log union all select event_id, '$.job.deep.a.b.c.Finish_note', concat('was ', upper(event)) from t_log where event like '%finish%'
union all select event_id, concat('$.tags[', n, ']'), event from t_log, (values (0), (2)) t(n) where event like '%finish%'""")
def nested_search(spark, sf):
    """Six levels deep, in a key and in values of another case."""
    e = S.log(spark, sf)
    k = F.get_json_object("props", "$.k").cast("long")
    deep = F.concat(F.lit("was "), F.upper("event")).alias("Finish_note")
    for name in ("c", "b", "a", "deep"):
        deep = F.struct(deep).alias(name)
    body = F.to_json(F.struct(F.col("chapter"), F.struct(F.col("state"), k.alias("k"), deep).alias("job"), F.array("event", (F.col("event_id") % 100).cast("string"), "event").alias("tags")))
    return out(V.nested_search(e.withColumn("body", body), "body", "fINISh", ["event_id"]), "event_id", "path", "value")
