"""The orphan buffer over whole tables: what a store holds after all changes have come, in the order of their arrival.

A change waits from its arrival until the last of its ancestors has come. Of a group's waiting changes the newest `most` are
kept; one more evicts the oldest, and its edges go with it. What descends from an evicted change can't be admitted, so it
waits on and may push out others. The evicted set is therefore worked out to a fixed point: each round takes what the round
before evicted as absent. It only grows, and ends at what the order of arrival gives.

Waiting times need no simulation: the time at which a change is complete is the greatest arrival in the prefixes that it has
seen of each chain. Groups that never have more than `most` waiting are told by a running sum. The others' arrivals and
completions run in time order through a buffer of `most` entries; a group is one sorted run of rows, read once a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.graph import NODE, Admissions, Causal
from driftwell.plans.lineage import cut


def complete_at(received: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, change_hash, latest): the greatest received_seq among a change and its ancestors, so far as they came."""
    causal = Causal(received, edges)
    along = Window.partitionBy("group_id", "chain").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    upto = causal.own.join(received.select(*NODE, "received_seq"), NODE).select("group_id", "chain", F.col("pos").alias("upto"), F.max("received_seq").over(along).alias("latest"))
    return causal.seen.join(upto, ["group_id", "chain", "upto"]).groupBy(*NODE).agg(F.max("latest").cast("long").alias("latest"))


def overflow(moves: DataFrame, most: int) -> DataFrame:
    """(group_id, change_hash) that a buffer of `most` drops, oldest first. moves: group_id, at, comes, change_hash."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for b in found:
            out: list[tuple] = []
            for own, comes, change in zip(*[b.column(c).to_pylist() for c in ("group_id", "comes", "change_hash")]):
                if own != group:
                    group, held = own, {}
                if not comes:
                    held.pop(change, None)
                    continue
                held[change] = None
                if len(held) > most:
                    oldest = next(iter(held))
                    del held[oldest]
                    out.append((own, oldest))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.schema.field("group_id").type), pa.array([x[1] for x in out], b.schema.field("change_hash").type)], names=["group_id", "change_hash"])

    kinds = dict(moves.dtypes)
    running = F.sum(F.when(F.col("comes"), 1).otherwise(-1)).over(Window.partitionBy("group_id").orderBy("at", F.col("comes").asc(), "change_hash").rowsBetween(Window.unboundedPreceding, 0))
    full = moves.withColumn("_n", running).filter(F.col("_n") > most).select("group_id").distinct()
    rows = moves.join(full, "group_id", "left_semi").repartition("group_id").sortWithinPartitions("group_id", "at", "comes", "change_hash")
    return rows.select("group_id", "comes", "change_hash").mapInArrow(batches, f"group_id {kinds['group_id']}, change_hash {kinds['change_hash']}")


def crowded(received: DataFrame, most: int) -> DataFrame:
    """(group_id) of groups with more than `most` arrivals; in the others a buffer of `most` can't overflow."""
    return cut(received.groupBy("group_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("group_id"))


def evictions(timed: DataFrame, admissions: Admissions, most: int) -> DataFrame:
    """NODE of what a buffer of `most` evicts, told to the admissions. timed: NODE, received_seq and latest of the groups to look at."""
    evicted, todo = None, timed
    while True:
        state = todo.join(admissions.admitted().select(*NODE, "admitted"), NODE)
        waits = cut(state.filter(~F.col("admitted") | (F.col("latest") > F.col("received_seq"))))
        comes = waits.select("group_id", F.col("received_seq").alias("at"), F.lit(True).alias("comes"), "change_hash")
        goes = waits.filter("admitted").select("group_id", F.col("latest").alias("at"), F.lit(False).alias("comes"), "change_hash")
        # Cut before it is dealt out: above a union of joins that AQE replans, a repartition by the join's key can be left out wrongly.
        found = cut(overflow(cut(comes.unionByName(goes)), most))
        fresh = found if evicted is None else cut(found.join(evicted, NODE, "left_anti"))
        if fresh.isEmpty():
            return found if evicted is None else evicted
        # Groups don't touch each other: those that dropped nothing new have come to their end.
        evicted = fresh if evicted is None else cut(evicted.unionByName(fresh))
        admissions.reject(fresh)
        todo = timed.join(fresh.select("group_id").distinct(), "group_id", "left_semi")


def bounded_buffer(received: DataFrame, edges: DataFrame, most: int = 4096) -> DataFrame:
    """(group_id, change_hash, received_seq, state, admitted_at) of received(group_id, change_hash, device_id, seq, received_seq).

    state: admitted (at admitted_at), orphan or evicted. Equal arrival numbers go by the hash.
    """
    edges = cut(edges.select("group_id", "child_hash", "parent_hash"))
    latest = complete_at(received, edges)
    timed = cut(received.select(*NODE, F.col("received_seq").cast("long").alias("received_seq")).join(latest, NODE))
    admissions = Admissions(received, edges)
    admissions.reject()
    evicted = evictions(timed.join(crowded(timed, most), "group_id", "left_semi"), admissions, most)
    state = timed.join(admissions.admitted(), NODE)
    gone = evicted.withColumn("_gone", F.lit(True))
    kind = F.when(F.col("_gone"), "evicted").when(F.col("admitted"), "admitted").otherwise("orphan")
    return state.join(gone, NODE, "left").select(*NODE, "received_seq", kind.alias("state"), F.when(kind == "admitted", F.col("latest")).alias("admitted_at"))


def held_orphans(received: DataFrame, edges: DataFrame, most: int = 4096) -> DataFrame:
    """(group_id, change_hash, received_seq) of the orphans of `bounded_buffer`.

    When a change is complete matters only where something can be evicted: times are worked out for crowded groups alone.
    """
    received = received.select(*NODE, "device_id", "seq", F.col("received_seq").cast("long").alias("received_seq"))
    edges = edges.select("group_id", "child_hash", "parent_hash")
    admissions = Admissions(received, edges, keep=("received_seq",))
    admissions.reject()
    groups = crowded(admissions.placed, most)
    evicted = None
    if not groups.isEmpty():
        own, between = (cut(x.join(groups, "group_id", "left_semi")) for x in (received, edges))
        evicted = evictions(cut(own.select(*NODE, "received_seq").join(complete_at(own, between), NODE)), admissions, most)
    orphans = admissions.admitted().filter("NOT admitted").select(*NODE, "received_seq")
    return orphans if evicted is None else orphans.join(evicted, NODE, "left_anti")


def held_edges(buffer: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that stay: those of admitted changes and of orphans that are not evicted."""
    there = buffer.filter("state <> 'evicted'").select("group_id", F.col("change_hash").alias("child_hash"))
    return edges.join(there, ["group_id", "child_hash"], "left_semi")


def admitted_heads(buffer: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, change_hash): admitted changes without an admitted child."""
    done = buffer.filter("state = 'admitted'").select(*NODE)
    parents = edges.join(done.withColumnRenamed("change_hash", "child_hash"), ["group_id", "child_hash"], "left_semi").select("group_id", F.col("parent_hash").alias("change_hash"))
    return done.join(parents, NODE, "left_anti")
