"""Admission of changes as they arrive, with a bounded buffer of orphans and the heads, kept in a keyed state store.

A change is admitted when all its parents are; one that comes before them waits. Of a group's waiting changes the newest
`most` are kept; an evicted one goes with its edges and has to come again. An admitted change is a head until it has an
admitted child.

State per group: admitted changes with their time and that of their first child, waiting changes with their parents and how
many of these are missing, the waiting children of each missing parent, and the order in which they came. A call to the store
costs more than the work on some kilobytes, so groups come to a worker in BUCKETS, and as many small groups of a bucket as fit
PAGE bytes are one value of the store, read once and written once in a batch. Groups beyond that have a page each, and a group
that outgrows a page has an entry for each change: an arrival reads and writes only those of the change, its parents and what
it sets free. A batch's work thus follows the batch, not the history. The store is RocksDB, checkpointed with the stream, so a
restarted stream goes on where it was.
"""

from __future__ import annotations

import pickle
import uuid
from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from driftwell.plans.lineage import deal_after_unions, new_folder, small_batches

EVENTS = "group_id long, change_hash string, event string, at long"
PAGE, BUCKETS = 1 << 18, 1 << 13
NEW = 0, 0, 0, pickle.dumps([{}] * 4)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Own:
    """A group's entries of a map state."""

    def __init__(self, state: Any, group: int):
        self.state, self.group = state, group

    def containsKey(self, key: tuple) -> bool:
        return self.state.containsKey((self.group, *key))

    def getValue(self, key: tuple) -> tuple:
        return self.state.getValue((self.group, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.state.updateValue((self.group, *key), value)

    def removeKey(self, key: tuple) -> None:
        self.state.removeKey((self.group, *key))


class Kept:
    """A map state behind a cache: each entry is read once and written once in a batch, each a call to the store.

    Of a group that the store does not know nothing is read; what comes and goes within a batch is neither written nor removed.
    The same holds of a group's page, whose entries the store does not have one by one.
    """

    def __init__(self, state: Any, empty: bool, page: dict | None = None):
        self.state, self.empty, self.now = state, empty, dict(page or {})
        self.stored = dict.fromkeys(self.now)

    def get(self, key: Any) -> tuple | None:
        if key not in self.now:
            there = not self.empty and self.state.containsKey((key,))
            self.now[key] = self.stored[key] = tuple(self.state.getValue((key,))) if there else None
        return self.now[key]

    def put(self, key: Any, value: tuple | None) -> None:
        self.get(key)
        self.now[key] = value

    def page(self) -> dict:
        return {key: value for key, value in self.now.items() if value is not None}

    def write(self) -> None:
        for key, value in self.now.items():
            if value is None and self.stored[key] is not None:
                self.state.removeKey((key,))
            elif value is not None and value != self.stored[key]:
                self.state.updateValue((key,), value)


class Admission(StatefulProcessor):
    """Emits (event, at) of changes: admitted, replaced (no head any more) and evicted, at the arrival that caused it."""

    def __init__(self, most: int, page: int = PAGE):
        self.most, self.most_bytes = most, page

    def init(self, handle: StatefulProcessorHandle) -> None:
        of, change = "group_id long, ", "group_id long, change string"
        self.states = [
            handle.getMapState("admitted", change, "at long, replaced long"),
            handle.getMapState("waiting", change, "nth long, missing long, parents array<string>"),
            handle.getMapState("children", of + "parent string", "waiting array<string>"),
            handle.getMapState("order", of + "nth long", "change string"),
        ]
        self.alone = handle.getMapState("alone", "group_id long", "first long, next long, held long, page binary")
        self.shared = handle.getValueState("shared", "page binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came: dict[int, list[tuple]] = {}
        for part in rows:
            for group, at, change, parents in zip(part["group_id"].tolist(), part["received_seq"].tolist(), part["change_hash"], part["parents"]):
                came.setdefault(group, []).append((at, change, parents))
        others, shared = pickle.loads(bytes(self.shared.get()[0])) if self.shared.exists() else (False, {})
        out: list[tuple] = []
        for group, arrived in came.items():
            alone = others and group not in shared and self.alone.containsKey((group,))
            state, events = self.arrive(group, self.alone.getValue((group,)) if alone else shared.get(group, NEW), arrived)
            out += [(group, *e) for e in events]
            if alone:
                self.alone.updateValue((group,), state)
            else:
                shared[group] = state
        room = self.most_bytes
        for group in sorted(shared, key=lambda g: len(shared[g][3] or b"")):
            page = shared[group][3]
            room -= 0 if page is None else len(page)
            if page is None or room < 0:
                others = True
                self.alone.updateValue((group,), shared.pop(group))
        self.shared.update((pickle.dumps((others, shared)),))
        if out:
            yield pd.DataFrame(dict(zip(("group_id", "change_hash", "event", "at"), map(list, zip(*out)))))

    def arrive(self, group: int, state: tuple, arrived: list[tuple]) -> tuple[tuple, list[tuple]]:
        """The group's state after its arrivals (at, change, parents), and their events (change, event, at)."""
        first, following, held, page = state
        pages = [None] * 4 if page is None else pickle.loads(bytes(page))
        admitted, waiting, children, order = kept = [Kept(Own(s, group), page is not None, p) for s, p in zip(self.states, pages)]
        out: list[tuple] = []

        def leave(change: str) -> tuple:
            nonlocal held
            entry = waiting.get(change)
            waiting.put(change, None)
            order.put(entry[0], None)
            held -= 1
            return entry

        def admit(change: str, parents: list[str], at: int) -> None:
            todo = deque([(change, parents)])
            while todo:
                change, parents = todo.popleft()
                admitted.put(change, (at, -1))
                out.append((change, "admitted", at))
                for p in parents:
                    shown, replaced = admitted.get(p)
                    if replaced < 0:
                        admitted.put(p, (shown, at))
                        out.append((p, "replaced", at))
                entry = children.get(change)
                if entry:
                    children.put(change, None)
                    for child in entry[0]:
                        nth, missing, own = waiting.get(child)
                        if missing > 1:
                            waiting.put(child, (nth, missing - 1, own))
                        else:
                            leave(child)
                            todo.append((child, list(own)))

        def evict(at: int) -> None:
            nonlocal first
            while order.get(first) is None:
                first += 1
            change = order.get(first)[0]
            for p in leave(change)[2]:
                entry = children.get(p)
                if entry:
                    rest = [c for c in entry[0] if c != change]
                    children.put(p, (rest,) if rest else None)
            out.append((change, "evicted", at))

        for at, change, parents in sorted(arrived, key=lambda a: a[:2]):
            if admitted.get(change) is not None or waiting.get(change) is not None:
                continue
            parents = sorted({*parents}) if parents is not None else []
            missing = [p for p in parents if admitted.get(p) is None]
            if not missing:
                admit(change, parents, at)
                continue
            waiting.put(change, (following, len(missing), parents))
            order.put(following, (change,))
            following, held = following + 1, held + 1
            for p in missing:
                entry = children.get(p)
                children.put(p, ([*entry[0], change] if entry else [change],))
            if held > self.most:
                evict(at)
        page = None if page is None else pickle.dumps([k.page() for k in kept])
        if page is None or len(page) > self.most_bytes:
            page = None
            for k in kept:
                k.write()
        return (first, following, held, page), out

    def close(self) -> None:
        pass


def with_parents(received: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, change_hash, received_seq, parents), the rows that `admission_events` takes. Changes may be known by numbers."""
    parents = edges.groupBy("group_id", F.col("child_hash").alias("change_hash")).agg(F.collect_set("parent_hash").alias("parents"))
    rows = received.join(parents, ["group_id", "change_hash"], "left")
    kinds = {"change_hash": "string", "received_seq": "long", "parents": "array<string>"}
    return rows.select("group_id", *[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])


def admission_events(arrivals: DataFrame, most: int = 4096, page: int = PAGE) -> DataFrame:
    """The stream of (group_id, change_hash, event, at) of a stream of arrivals. Runs with the store of `write_events`."""
    dealt = arrivals.withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(Admission(most, page), EVENTS, "Append", "None")


def write_events(spark: SparkSession, arrivals: DataFrame, folder: str, most: int = 4096, page: int = PAGE) -> None:
    """Takes what is there of the stream of arrivals and adds its events to the folder's table; called again, it goes on.

    The folder holds the stream's checkpoint beside the table, so a batch that is run again after a loss counts once.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        writer = admission_events(arrivals, most, page).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/state")
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def in_parts(rows: DataFrame, size: int) -> DataFrame:
    """rows(group_id, received_seq, ...) as a stream of files, written one stretch of `size` arrivals after another.

    A stretch holds all of a group's rows in one file, so that a group's files are as old as its arrivals. Rows are first written
    by their stretches, so that each is read once.
    """
    spark, schema = rows.sparkSession, rows.schema
    folder, sorted_out = new_folder(spark, "arrivals"), new_folder(spark, "stretches")
    deal_after_unions(spark)
    small_batches(spark)
    rows.withColumn("part", F.floor((F.col("received_seq") - 1) / F.lit(size))).write.partitionBy("part").parquet(sorted_out)
    parts = spark.read.schema(StructType([*schema, StructField("part", LongType())])).parquet(sorted_out)
    for n in range(int(parts.agg(F.max("part")).first()[0] or 0) + 1):
        parts.filter(F.col("part") == n).drop("part").repartition("group_id").write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)


def events_of(spark: SparkSession, received: DataFrame, edges: DataFrame, most: int = 4096, size: int = 1 << 20) -> DataFrame:
    """The events of a table of received changes, run through the stream."""
    folder = new_folder(spark, f"admission-{uuid.uuid4().hex[:8]}")
    write_events(spark, in_parts(with_parents(received, edges), size), folder, most)
    return spark.read.schema(EVENTS).parquet(f"{folder}/events")
