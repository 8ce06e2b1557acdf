"""Streaming operators, each with a batch twin that gives the same rows for bounded input.

Debounce sessions keep state per group; the journal and the orphan buffer are tables that one batch after another renews.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the debouncer, in microseconds and paths.
QUIET, LONGEST, BURST = 300_000, 2_000_000, 500
SESSION = "group_id long, started long, ended long, n_events long, n_paths long, burst boolean, last_kinds string"


def sessions_of(rows: pd.DataFrame, quiet: int, longest: int, burst: int) -> pd.DataFrame:
    """Debounced sessions of one group's events in time order; the last kind of each path wins."""
    out: list[tuple] = []
    start = last = None
    kinds: dict[str, str] = {}
    n = 0

    def flush() -> None:
        if n:
            many = len(kinds) > burst
            text = "" if many else ",".join(f"{p}={k}" for p, k in sorted(kinds.items()))
            out.append((int(rows["group_id"].iloc[0]), int(start), int(last), n, len(kinds), many, text))

    for us, path, kind in rows.sort_values(["us", "event_id"], kind="stable")[["us", "path", "kind"]].itertuples(index=False):
        if start is None or us - last > quiet or us - start > longest:
            flush()
            start, kinds, n = us, {}, 0
        last, n = us, n + 1
        kinds[path] = kind
    flush()
    return pd.DataFrame(out, columns=["group_id", "started", "ended", "n_events", "n_paths", "burst", "last_kinds"])


def debounce(events: DataFrame, quiet: int = QUIET, longest: int = LONGEST, burst: int = BURST) -> DataFrame:
    """Batch twin: sessions end after a quiet gap or at their greatest length.

    No session crosses a gap of over `quiet`, so stretches between such gaps can be folded apart; 64 of them make one piece
    of work, however long a group's history is.
    """
    order = Window.partitionBy("group_id").orderBy("us", "event_id")
    fresh = F.coalesce((F.col("us") - F.lag("us").over(order) > quiet).cast("int"), F.lit(1))
    stretches = events.withColumn("_fresh", fresh).withColumn("_stretch", F.floor(F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) / 64))
    return stretches.select("group_id", "_stretch", "us", "event_id", "path", "kind").groupBy("group_id", "_stretch").applyInPandas(lambda rows: sessions_of(rows, quiet, longest, burst), SESSION)


def debounce_stream(events: DataFrame, quiet: int = QUIET, longest: int = LONGEST, burst: int = BURST, delay: str = "1 minute") -> DataFrame:
    """Streaming form: a session's events wait in state until a later event of the group, or a timer, closes the session.

    The timer runs on event time: it fires when the watermark, which other groups' events move too, passes the quiet gap or
    the greatest length. Events later than `delay` are dropped by the watermark.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    columns = ["group_id", "us", "event_id", "path", "kind"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(json.loads(state.get[0]) if state.exists else [], columns=columns)
        rows = pd.concat([held, *(b[columns] for b in batches)], ignore_index=True).sort_values(["us", "event_id"])
        done = sessions_of(rows, quiet, longest, burst)
        started, ended = int(done["started"].iloc[-1]), int(done["ended"].iloc[-1])
        closes = min(ended + quiet, started + longest) // 1000 + 1
        if state.hasTimedOut or closes < state.getCurrentWatermarkMs():
            state.remove()
            yield done
        else:
            state.update((json.dumps(rows.loc[rows["us"] >= started, columns].values.tolist()),))
            state.setTimeoutTimestamp(max(closes, state.getCurrentWatermarkMs() + 1))
            yield done.iloc[:-1]

    timed = events.select(*columns, F.timestamp_micros("us").alias("ts")).withWatermark("ts", delay)
    return timed.groupBy("group_id").applyInPandasWithState(step, SESSION, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def first_sight(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each change hash once. Streaming input: within the watermark; batch input: at all."""
    if changes.isStreaming:
        return changes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["change_hash"])
    return changes.dropDuplicates(["change_hash"])


def hourly_counters(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events and their value per type and hour."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def throughput(attempts: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Bytes per second in fixed windows of five seconds."""
    rows = attempts.withWatermark("ts", delay) if attempts.isStreaming else attempts
    return rows.groupBy(F.window("ts", "5 seconds").alias("w"), "device_id").agg(F.sum("bytes").alias("bytes")).select(F.col("w.start").alias("start"), "device_id", "bytes", (F.col("bytes") / 5).alias("per_second"))


def upsert_dirty(journal: DataFrame | None, events: DataFrame) -> DataFrame:
    """The dirty-path journal after more events: first_seen stays, the latest kind and time replace, attempts add up."""
    fresh = events.groupBy("group_id", "path").agg(F.min("us").alias("first_seen"), F.max("us").alias("observed_at"), F.max_by("kind", F.struct("us", "event_id")).alias("kind"), F.count("*").alias("attempts"))
    if journal is None:
        return fresh
    both = journal.unionByName(fresh)
    return both.groupBy("group_id", "path").agg(F.min("first_seen").alias("first_seen"), F.max("observed_at").alias("observed_at"), F.max_by("kind", "observed_at").alias("kind"), F.sum("attempts").alias("attempts"))


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], spark: SparkSession, mode: str = "append") -> None:
    """Runs a stream over what is there now, calling each(batch, number)."""
    import uuid

    from driftwell.plans.lineage import shared_folder

    writer = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def folded(stream: DataFrame, step: Callable[[DataFrame | None, DataFrame], DataFrame], spark: SparkSession, mode: str = "append") -> DataFrame:
    """A table kept by a stream's batches: step(table before, batch) gives the table after, written beside the one before.

    A batch that is run again overwrites its own table and starts from the same one before, so nothing counts twice.
    """
    import uuid

    from driftwell.plans.lineage import shared_folder

    folder = f"{shared_folder(spark)}/fold-{uuid.uuid4().hex}"
    last = [-1]

    def each(batch: DataFrame, n: int) -> None:
        before = batch.sparkSession.read.parquet(f"{folder}/{n - 1}") if n else None
        step(before, batch).write.mode("overwrite").parquet(f"{folder}/{n}")
        last[0] = n

    drain(stream, each, spark, mode)
    if last[0] < 0:
        return step(None, spark.createDataFrame([], stream.schema))
    return spark.read.parquet(f"{folder}/{last[0]}")


def collected(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """All rows that a stream emits over what is there now, as a table in the shared folder.

    In complete mode each batch emits the whole result, so the last batch's is taken.
    """
    import uuid

    from driftwell.plans.lineage import shared_folder

    if mode == "complete":
        return folded(stream, lambda before, batch: batch, spark, mode)
    folder = f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"
    drain(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/n={n}"), spark, mode)
    return spark.read.schema(stream.schema).parquet(f"{folder}/*") if _written(spark, folder) else spark.createDataFrame([], stream.schema)


def _written(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def dirty_journal(events: DataFrame, spark: SparkSession) -> DataFrame:
    """The dirty-path journal after all of a stream's batches."""
    return folded(events, upsert_dirty, spark)


def running_heads(received: DataFrame, edges: DataFrame) -> DataFrame:
    """Since when each received change is a head, and when the first later child replaces it (-1: it still is one).

    received may be a stream (complete mode) beside a table of edges: a child's row is one more row of each parent.
    """
    own = F.struct(F.col("change_hash").alias("change_hash"), F.col("received_seq").cast("long").alias("shown"), F.lit(None).cast("long").alias("child"))
    as_child = F.transform(F.coalesce("parents", F.array().cast("array<string>")), lambda p: F.struct(p.alias("change_hash"), F.lit(None).cast("long").alias("shown"), F.col("received_seq").cast("long").alias("child")))
    parents = edges.groupBy("group_id", F.col("child_hash").alias("change_hash")).agg(F.collect_list("parent_hash").alias("parents"))
    rows = received.join(parents, ["group_id", "change_hash"], "left").select("group_id", F.explode(F.concat(F.array(own), as_child)).alias("x")).select("group_id", "x.*")
    met = rows.groupBy("group_id", "change_hash").agg(F.max("shown").alias("shown_at"), F.collect_set("child").alias("children")).filter("shown_at IS NOT NULL")
    return met.select("group_id", "change_hash", "shown_at", F.coalesce(F.array_min(F.filter("children", lambda at: at > F.col("shown_at"))), F.lit(-1)).alias("replaced_at"))


def lease_pins(leases: DataFrame, now_us: int, margin_us: int = 60_000_000) -> DataFrame:
    """leases(group_id, path, version_seq, us, ttl_us): each pin's end, which renewals put off, and whether it is live.

    A lease without a positive ttl pins nothing. A stream runs it in complete mode.
    """
    ends = F.max(F.col("us") + F.col("ttl_us") + F.lit(margin_us)).alias("pinned_until")
    return leases.filter("ttl_us > 0").groupBy("group_id", "path", "version_seq").agg(ends).withColumn("live", F.col("pinned_until") > now_us)


def acked_frontier(acks: DataFrame) -> DataFrame:
    """The change that each device acknowledged last; an acknowledgement replaces the one before. A stream runs it in complete mode."""
    return acks.groupBy("group_id", "device_id").agg(F.max_by("change_hash", F.struct("us", "change_hash")).alias("change_hash"))
