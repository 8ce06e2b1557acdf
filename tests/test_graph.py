"""Change graphs against sets: chains that break, deep histories, admission with holes and rejected changes."""

import random

import pytest
from pyspark.sql import functions as F

from driftwell.operators import graph as G
from driftwell.operators import orphans as R
from driftwell.plans.lineage import new_folder
from driftwell.streaming import admission as A

CHANGES = "group_id long, change_hash string, device_id string, seq long, received_seq long"
EDGES = "group_id long, child_hash string, parent_hash string"


def history(seed, n=60, devices=4, chained=0.9):
    """Random parents; a device's last change is among them with a chance of `chained`. Two groups share hashes."""
    rng = random.Random(seed)
    changes, edges, parents = [], [], {}
    for group in (1, 2):
        last, count = {}, {}
        for i in range(n):
            device = f"d{rng.randrange(devices)}"
            mine = set(rng.sample(range(i), min(i, rng.choice([0, 0, 1, 1, 2]))))
            if device in last and rng.random() < chained:
                mine.add(last[device])
            last[device], count[device] = i, count.get(device, 0) + 1
            parents[group, i] = {(group, p) for p in mine}
            changes.append((group, f"c{i:03}", device, count[device], rng.randrange(10**6)))
            edges += [(group, f"c{i:03}", f"c{p:03}") for p in mine]
    return changes, edges, parents


def name(x):
    return x[0], f"c{x[1]:03}"


def above(parents):
    """All strict ancestors, and Lamport numbers."""
    up, clock = {}, {}
    for x in sorted(parents):
        up[x] = set().union(*[up[p] | {p} for p in parents[x]]) if parents[x] else set()
        clock[x] = 1 + max((clock[p] for p in parents[x]), default=0)
    return up, clock


@pytest.mark.parametrize("seed,chained", [(1, 1.0), (2, 0.8), (3, 0.0)])
def test_causal_against_sets(spark, seed, chained):
    changes, edges, parents = history(seed, chained=chained)
    up, clock = above(parents)
    cs, es = spark.createDataFrame(changes, CHANGES), spark.createDataFrame([*edges, (1, "c000", "nowhere"), (1, "nowhere", "c001")], EDGES)
    causal = G.Causal(cs, es)
    assert {(r.group_id, r.change_hash): r.lamport for r in causal.lamports.collect()} == {name(x): n for x, n in clock.items()}
    every = cs.select("group_id", F.col("change_hash").alias("a")).join(cs.select("group_id", F.col("change_hash").alias("b")), "group_id")
    found = {(r.group_id, r.a, r.b) for r in causal.precedes(every).filter("precedes").collect()}
    assert found == {(x[0], name(a)[1], name(x)[1]) for x in up for a in up[x]}
    rng = random.Random(seed)
    tops = [(x, k) for k in "pq" for x in rng.sample(sorted(up), 5)]
    frontier = spark.createDataFrame([(x[0], k, name(x)[1]) for x, k in tops] + [(1, "p", "unknown")], "group_id long, k string, change_hash string")
    found = sorted(tuple(r) for r in causal.closure(frontier, ["group_id", "k"]).collect())
    assert found == sorted({(y[0], k, name(y)[1]) for x, k in tops for y in up[x] | {x}} | {(1, "p", "unknown")})
    device = {(g, h): (d, s) for g, h, d, s, _ in changes}
    wanted = {}
    for x in up:
        for y in up[x] | {x}:
            d, s = device[name(y)]
            wanted[(*name(x), d)] = max(s, wanted.get((*name(x), d), 0))
    assert {(r.group_id, r.change_hash, r.device_id): r.seq for r in causal.device_vectors().collect()} == wanted


@pytest.mark.parametrize("seed,chained", [(4, 1.0), (5, 0.7)])
def test_admission_against_sets(spark, seed, chained):
    changes, edges, parents = history(seed, chained=chained)
    up, _ = above(parents)
    rng = random.Random(seed)
    gone = {x for x in up if rng.random() < 0.04}
    rejected = {x for x in up if x not in gone and rng.random() < 0.03}
    seq = {(g, h): n for g, h, _, _, n in changes}
    here = [c for c in changes if c[:2] not in {name(x) for x in gone}]
    received, es = spark.createDataFrame(here, CHANGES), spark.createDataFrame(edges, EDGES)
    no = spark.createDataFrame([name(x) for x in rejected], "group_id long, change_hash string")
    ok = {x for x in up if not (up[x] | {x}) & gone}
    assert {(r.group_id, r.change_hash): r.admitted for r in G.admitted(received, es).collect()} == {name(x): x in ok for x in up if x not in gone}
    still = {x for x in ok if not (up[x] | {x}) & rejected}
    assert {(r.group_id, r.change_hash): r.admitted for r in G.admitted(received, es, no).collect()} == {name(x): x in still for x in up if x not in gone}
    at = {(r.group_id, r.change_hash): r.admitted_at for r in R.bounded_buffer(received, es).collect()}
    assert at == {name(x): max(seq[name(y)] for y in up[x] | {x}) if x in ok else None for x in up if x not in gone}


def one_by_one(changes, parents, most):
    """The buffer, change by change: events, and what is left waiting."""
    events, waiting = [], {}
    for group in sorted({c[0] for c in changes}):
        done, held = {}, []
        def admit(x, at):
            done[x] = at
            events.append((*name(x), "admitted", at))
            for p in parents[x]:
                if (*name(p), "replaced") not in {e[:3] for e in events}:
                    events.append((*name(p), "replaced", at))
        for _, h, _, _, at in sorted((c for c in changes if c[0] == group), key=lambda c: c[4]):
            x = (group, int(h[1:]))
            if parents[x] <= set(done):
                admit(x, at)
                while ready := [w for w in held if parents[w] <= set(done)]:
                    held.remove(ready[0])
                    admit(ready[0], at)
            else:
                held.append(x)
                if len(held) > most:
                    events.append((*name(held.pop(0)), "evicted", at))
        waiting |= {x: True for x in held}
    return events, set(waiting)


@pytest.mark.parametrize("seed,most", [(6, 3), (7, 10), (8, 1000)])
def test_bounded_buffers_against_arrivals(spark, seed, most):
    """In batch, and by a stream that is stopped and started again halfway."""
    changes, edges, parents = history(seed, n=50, chained=0.9)
    rng = random.Random(seed)
    order = iter(rng.sample(range(1, 101), 100))
    changes = [(*c[:4], next(order)) for c in changes if rng.random() > 0.03]
    events, waiting = one_by_one(changes, parents, most)
    received, es = spark.createDataFrame(changes, CHANGES), spark.createDataFrame(edges, EDGES)
    buffer = R.bounded_buffer(received, es, most).cache()
    found = {(r.group_id, r.change_hash): (r.state, r.admitted_at) for r in buffer.collect()}
    evicted = {e[:2] for e in events if e[2] == "evicted"}
    assert bool(evicted) == (most < 1000)
    assert found == {e[:2]: ("admitted", e[3]) for e in events if e[2] == "admitted"} | {e: ("evicted", None) for e in evicted} | {name(x): ("orphan", None) for x in waiting}
    assert {r.child_hash for r in R.held_edges(buffer, es).filter("group_id = 1").collect()} == {h for (g, h), s in found.items() if g == 1 and s[0] != "evicted" and parents[g, int(h[1:])]}
    heads = {e[:2] for e in events if e[2] == "admitted"} - {e[:2] for e in events if e[2] == "replaced"}
    assert {tuple(r) for r in R.admitted_heads(buffer, es).collect()} == heads

    folder, rows = new_folder(spark, "test"), A.with_parents(received, es)
    for part in ("received_seq <= 40", "received_seq > 40 AND received_seq <= 70", "received_seq > 70"):
        rows.filter(part).repartition("group_id").write.mode("append").parquet(f"{folder}/in")
        again = rows.filter("received_seq = 40")
        again.write.mode("append").parquet(f"{folder}/in")
        A.write_events(spark, spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/out", most)
    found = [tuple(r) for r in spark.read.parquet(f"{folder}/out/events").collect()]
    back = {e[:2] for e in events if e[2] == "evicted"} & {(c[0], c[1]) for c in changes if c[4] == 40}
    if not back:
        assert sorted(found) == sorted(events)


def test_a_deep_history_takes_few_rounds(spark):
    """100,000 changes in one line that goes over to another of three devices at every second change."""
    n, size = F.col("id"), 100_000
    device = F.pmod(F.floor((n + 1) / 2), F.lit(3))
    rows = spark.range(size).select(F.lit(1).cast("long").alias("group_id"), F.lpad(n.cast("string"), 6, "0").alias("change_hash"), F.concat(F.lit("d"), device).alias("device_id"), (n + 1).alias("seq"), n)
    line = rows.filter("id > 0").select("group_id", F.col("change_hash").alias("child_hash"), F.lpad((n - 1).cast("string"), 6, "0").alias("parent_hash"))
    own = rows.select("group_id", "change_hash", F.lag("change_hash").over(G.Window.partitionBy("device_id").orderBy("seq")).alias("parent_hash")).filter("parent_hash IS NOT NULL")
    edges = line.union(own.select("group_id", F.col("change_hash").alias("child_hash"), "parent_hash")).distinct()
    causal = G.Causal(rows, edges)
    assert causal.lamports.join(rows, G.NODE).filter("lamport <> id + 1").isEmpty()
    assert causal.closure(rows.filter(n == size - 1).select(*G.NODE)).count() == size
    assert causal.rounds < 22
