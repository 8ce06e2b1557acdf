"""The prune plan of F24 and F25: what it asks of the history, and that it is the one by definition."""

import random

from driftwell.operators import graph as G
from driftwell.operators import pruning as P
from driftwell.plans import changes
from driftwell.plans.catalog import Views

FOLDER = "/root/testdata/sf0.001"


def test_a_plan_asks_for_what_the_frontiers_see_only(spark, monkeypatch):
    """Neither what every jump sees nor the edges are written and dealt out again."""

    def refuse(self):
        raise AssertionError("the whole history was asked for")

    v = Views(spark, FOLDER)
    expected = sorted(map(tuple, changes.numbered_plan(v).collect())) if hasattr(G.Causal, "upto") else None
    monkeypatch.setattr(G.Causal, "reach", property(refuse))
    monkeypatch.setattr(G.Causal, "edges", property(refuse))
    assert sorted(map(tuple, changes.numbered_plan(v).collect())) == expected


def history(rng, group, n):
    """Changes of three devices with parents before them; some do not have their device's last one, so chains are cut."""
    rows, edges, last = [], [], {}
    for i in range(n):
        device = f"d{rng.randrange(3)}"
        name = f"{group}-{i}"
        parents = {last[device]} if device in last and rng.random() < 0.8 else set()
        if i and rng.random() < 0.4:
            parents.add(f"{group}-{rng.randrange(i)}")
        if rng.random() < 0.05:
            parents.add("nowhere")
        rows.append((group, name, device, i))
        edges += [(group, name, p) for p in parents]
        last[device] = name
    return rows, edges


def test_a_plan_by_definition(spark):
    rng = random.Random(11)
    rows, edges, frontiers = [], [], []
    for group in range(25):
        own, links = history(rng, group, rng.randint(1, 40))
        rows += own
        edges += links
        for device in sorted({r[2] for r in own}):
            if group % 6:
                frontiers += [(group, device, rng.choice(own[len(own) // 2 :])[1]) for _ in range(rng.randint(1, 2))]
        if group % 5 == 1:
            frontiers.append((group, "d0", "unknown"))
    parents = {}
    for _, child, parent in edges:
        parents.setdefault(child, set()).add(parent)
    known, expected = {r[1] for r in rows}, set()
    for group in range(25):
        devices = {r[2] for r in rows if r[0] == group}
        has = {}
        for g, device, change in frontiers:
            if g == group and change in known:
                open_ = [change]
                while open_:
                    now = open_.pop()
                    if now in known and now not in has.setdefault(device, set()):
                        has[device].add(now)
                        open_ += parents.get(now, ())
        common = set.intersection(*(has.get(d, set()) for d in devices))
        below = {p for c in common for p in parents.get(c, ())}
        expected |= {(group, c, "pruned" if c in below else "frontier") for c in common}
    changes_ = spark.createDataFrame(rows, "group_id long, change_hash string, device_id string, seq long")
    links = spark.createDataFrame(edges, "group_id long, child_hash string, parent_hash string")
    known_to = spark.createDataFrame(frontiers, "group_id long, device_id string, change_hash string")
    found = [tuple(r) for r in G.prune_plan(known_to, changes_.select("group_id", "device_id").distinct(), links, changes_).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert {r[2] for r in expected} == {"pruned", "frontier"}


def test_trashed_versions_are_those_of_files(spark):
    v = Views(spark, FOLDER)
    files = v.numbered.fx_files.filter("state = 'trashed' AND version_hash IS NOT NULL").select("group_id", "version_hash").distinct()
    touches = P.trashed(v.undealt.fx_touches).filter("authorized AND version_hash IS NOT NULL").select("group_id", "version_hash").distinct()
    assert sorted(map(tuple, files.collect())) == sorted(map(tuple, touches.collect())) and files.count()


def test_blocks_meet_what_is_asked_once(spark):
    """rights of both kinds are put together first, so the asked blocks are dealt out for one join, not two."""
    v = Views(spark, FOLDER)
    asked = v.fx_stored.select("group_id", "hash")
    versions = spark.createDataFrame([(1, "a", True, False), (1, "b", False, True), (2, "a", True, True)], "group_id long, version_hash string, left boolean, authorized boolean")
    blocks = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("a", "z")], "version_hash string, hash string")
    wanted = spark.createDataFrame([(1, "x"), (1, "y"), (1, "w"), (2, "z"), (2, "y")], "group_id long, hash string")
    found = {(r.group_id, r.hash): r.verdict for r in P.authorized_blocks(wanted, blocks, versions.filter("left"), versions.filter("authorized")).collect()}
    assert found == {(1, "x"): "retained", (1, "y"): "compaction", (1, "w"): "refused", (2, "z"): "retained", (2, "y"): "refused"}
    own = asked._jdf.queryExecution().optimizedPlan().toString().count("Join")
    plan = P.authorized_blocks(asked, blocks, versions.filter("left"), versions.filter("authorized"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") - own == 2
