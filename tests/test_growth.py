"""What is shuffled and kept on the way to a result, beside the results themselves."""

import random

import pandas as pd
import pytest

from driftwell.operators import graph as G
from driftwell.operators import history as H
from driftwell.operators import merkle as M
from driftwell.operators import orphans as R
from driftwell.operators import pruning as P
from driftwell.plans import all_queries
from driftwell.plans.catalog import Views
from driftwell.plans.lineage import new_folder
from driftwell.streaming import admission as A

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries()


def history(seed: int, n: int = 60, groups: int = 2) -> tuple[list, list]:
    """changes (group_id, change_hash, device_id, seq) and edges of random histories, some runs of a device broken."""
    rng, changes, edges = random.Random(seed), [], []
    for g in range(groups):
        last, seq, there = {}, {}, []
        for k in range(n):
            name, device = f"g{g}n{k}", f"d{rng.randrange(3)}"
            seq[device] = seq.get(device, 0) + 1
            parents = {last[device]} if device in last and rng.random() < 0.8 else set()
            parents |= set(rng.sample(there, min(len(there), rng.randrange(3)))) if rng.random() < 0.4 else set()
            changes.append((g, name, device, seq[device]))
            edges += [(g, name, p) for p in parents]
            last[device] = name
            there.append(name)
    return changes, edges


def frames(spark, changes, edges):
    return spark.createDataFrame(changes, "group_id long, change_hash string, device_id string, seq long"), spark.createDataFrame(edges, "group_id long, child_hash string, parent_hash string")


@pytest.mark.parametrize("seed", range(3))
def test_pairs_are_those_of_the_doubling(spark, seed):
    changes, edges = frames(spark, *history(seed))
    found = sorted(map(tuple, G.Causal(changes, edges).pairs().collect()))
    assert found == sorted((r.group_id, r.change_hash, r.ancestor) for r in G.ancestors(edges).collect())


def test_ancestor_pairs_are_not_dealt_out(spark):
    plan = QUERIES["gr1_ancestor_closure"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    # Only the join that makes the pairs and what leads to it: no aggregate or union stands above it.
    assert "Aggregate" not in plan.split("Join")[0] and "Union" not in plan.split("Join")[0] and "Join" in plan


def test_a_buffer_places_its_chains_once(spark, monkeypatch):
    changes, edges = history(5, n=80, groups=1)
    order = random.Random(5).sample(range(len(changes)), len(changes))
    received = spark.createDataFrame([(*c, at) for c, at in zip(changes, order)], "group_id long, change_hash string, device_id string, seq long, received_seq long")
    calls, own = [], G.in_chains
    monkeypatch.setattr(G, "in_chains", lambda *a: calls.append(1) or own(*a))
    found = R.bounded_buffer(received, frames(spark, changes, edges)[1], 3)
    assert found.filter("state = 'evicted'").count() > 0
    assert len(calls) == 2  # one for the times, one for the admissions, however many rounds there are


def test_numbered_changes_through_a_buffer(spark):
    received = spark.createDataFrame([(1, n, "d", n, 9 - n) for n in range(1, 9)], "group_id long, change_hash long, device_id string, seq long, received_seq long")
    edges = spark.createDataFrame([(1, n + 1, n) for n in range(1, 8)], "group_id long, child_hash long, parent_hash long")
    found = {r.change_hash: r.state for r in R.bounded_buffer(received, edges, 2).collect()}
    assert found == {1: "admitted", 2: "admitted", 3: "admitted", **{n: "evicted" for n in range(4, 9)}}


def test_stubs_stay_in_their_devices_chains(spark, monkeypatch):
    """Two devices side by side, all but the heads pruned: by Lamport numbers alone no stub follows the one before."""
    rows = [(1, f"{d}{n}", d, n) for d in "xy" for n in range(1, 9)]
    changes, edges = frames(spark, rows, [(1, f"{d}{n}", f"{d}{n - 1}") for d in "xy" for n in range(2, 9)])
    plan = changes.filter("seq < 8").selectExpr("group_id", "change_hash", "'pruned' AS role")
    none = spark.createDataFrame([], "group_id long, change_hash string, version_hash string")
    lamports = changes.selectExpr("group_id", "change_hash", "seq AS lamport")
    snapshot = P.pruned(changes, edges, none, plan, none, none, lamports)
    made = []
    monkeypatch.setattr(P, "Causal", lambda *a: made.append(G.Causal(*a)) or made[-1])
    assert {r.verdict for r in P.audit_retained(snapshot).collect()} == {"reached"}
    assert made[0].own.select("chain").distinct().count() == 2


class Store:
    def __init__(self):
        self.values, self.calls = {}, []

    def __getattr__(self, name):
        def call(key, value=None):
            self.calls.append(name)
            if name == "updateValue":
                self.values[key] = value
            if name == "containsKey":
                return key in self.values
            return self.values.pop(key, None) if name == "removeKey" else self.values.get(key)

        return call


def test_a_new_groups_state_is_only_written():
    store = Store()
    kept = A.Kept(store, True)
    kept.put("gone", (1,))
    kept.put("stays", (2,))
    kept.put("gone", None)
    kept.write()
    assert store.calls == ["updateValue"]
    later = A.Kept(store, False)
    assert later.get("gone") is None and later.get("other") is None


class Handle:
    """What a processor asks of Spark, over stores that outlast a batch."""

    def __init__(self):
        self.stores = {}

    def getMapState(self, name, *_):
        return self.stores.setdefault(name, Store())

    def getValueState(self, name, *_):
        store = self.stores.setdefault(name, Store())
        return type("Value", (), {"exists": lambda _: store.containsKey(()), "get": lambda _: store.getValue(()), "update": lambda _, x: store.updateValue((), x)})()


def in_batches(most: int, page: int, seeds: range, size: int = 20) -> tuple[list, list]:
    """Events of three groups of a bucket, whose arrivals come in batches, and the calls to the store in each batch."""
    rows = []
    for g, seed in enumerate(seeds):
        changes, edges = history(seed, n=70, groups=1)
        rng = random.Random(seed)
        for at, n in enumerate(rng.sample(range(70), 66)):
            rows.append((g, changes[n][1], at + 1, [p for _, c, p in edges if c == changes[n][1]] or None))
    handle, events, calls = Handle(), [], []
    for low in range(0, 70, size):
        processor = A.Admission(most, page)
        processor.init(handle)
        here = pd.DataFrame([r for r in rows if low < r[2] <= low + size], columns=["group_id", "change_hash", "received_seq", "parents"])
        for out in processor.handleInputRows((5,), iter([here.iloc[::2], here.iloc[1::2]]), None):
            events += out[["group_id", "change_hash", "event", "at"]].itertuples(index=False, name=None)
        calls.append(sum(len(s.calls) for s in handle.stores.values()) - sum(calls))
    return sorted(events), calls


def test_small_groups_share_an_entry_of_the_store():
    events, calls = in_batches(1000, A.PAGE, range(3))
    assert {e[0] for e in events} == {0, 1, 2} and max(calls) <= 3  # is it there, what is it, and what it is now


@pytest.mark.parametrize("most", [3, 1000])
def test_pages_give_the_same_events_as_entries(most):
    """Groups in one page, some with a page of their own, and some that outgrow it on the way."""
    wanted, _ = in_batches(most, A.PAGE, range(3))
    assert any(e[2] == "evicted" for e in wanted) == (most < 1000)
    for page in (0, 500, 2500, 6000):
        assert in_batches(most, page, range(3))[0] == wanted


@pytest.mark.parametrize("page", [0, 3000])
def test_pages_and_entries_through_a_stream(spark, page):
    """In the store itself, stopped and started again between stretches."""
    received, edges = arrivals(spark, 6)
    rows = A.with_parents(received, edges)
    found = []
    for most_bytes in (A.PAGE, page):
        folder = new_folder(spark, "test")
        for low in (0, 40, 70):
            rows.filter(f"received_seq >= {low} AND received_seq < {[40, 70, 100][low // 35]}").repartition("group_id").write.mode("append").parquet(f"{folder}/in")
            A.write_events(spark, spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/out", 5, most_bytes)
        found.append(sorted(map(tuple, spark.read.parquet(f"{folder}/out/events").collect())))
    assert found[0] == found[1] and {e[2] for e in found[0]} == {"admitted", "replaced", "evicted"}


def test_a_stream_in_parts_has_each_row_once(spark):
    """Numbers become strings on the way, and stretches without rows do no harm."""
    received = spark.createDataFrame([(g, n, n * n) for g in (1, 2) for n in range(1, 9)], "group_id long, change_hash long, received_seq int")
    edges = spark.createDataFrame([(1, n + 1, n) for n in range(1, 8)], "group_id long, child_hash long, parent_hash long")
    found = A.events_of(spark, received, edges, size=4).filter("event = 'admitted'").collect()
    assert sorted((r.group_id, int(r.change_hash), r.at) for r in found) == [(g, n, n * n) for g in (1, 2) for n in range(1, 9)]


def test_heads_are_read_off_the_events_once(spark):
    """Since when a change is a head and when it is replaced come from one grouping, without a join of the events with themselves."""
    assert "Join" not in QUERIES["st4_running_heads"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def test_trees_deal_out_packed_items_once_a_level(spark, monkeypatch):
    """What travels is 32 bytes an item, and neither small nor large nodes are looked up by joins."""
    cuts = []
    own = M.cut
    monkeypatch.setattr(M, "cut", lambda df: cuts.append(df) or own(df))
    rows = spark.createDataFrame([(k, f"a{i}") for k in range(3) for i in range(100 * k + 20)], "k int, name string")
    M.tree(M.hashed(rows, ["k"], "name"), ["k"])
    assert all(dict(c.dtypes).get("item", "binary") == "binary" for c in cuts)
    assert not any("Join" in c._jdf.queryExecution().optimizedPlan().toString() for c in cuts)


@pytest.mark.parametrize("bulk", [8, 1 << 16])
def test_bulky_nodes_give_the_same_tree(spark, bulk):
    rows = spark.createDataFrame([(k, f"a{i}") for k in range(3) for i in range(50 * k + 3)], "k int, name string")
    items = M.packed(M.hashed(rows, ["k"], "name")).selectExpr("k", "item", "'' AS start")
    wanted = sorted(map(tuple, M.tree(M.hashed(rows, ["k"], "name"), ["k"], 4).collect()))
    assert sorted(map(tuple, M.subtrees(items, ["k"], 4, bulk).select("k", "prefix", "n", "digest").collect())) == wanted


def test_a_snapshots_manifest_is_worked_out_once(spark, monkeypatch):
    calls, own = [], P.manifest_of
    monkeypatch.setattr(P, "manifest_of", lambda *a: calls.append(1) or own(*a))
    QUERIES["gr15_pruned_snapshot"](spark, FOLDER).collect()
    assert len(calls) == 1


def test_groups_that_ended_are_not_relaxed_again(spark, monkeypatch):
    """One winding history beside many short ones: the paths of these are left out after their last round."""
    changes, edges = history(0, n=70, groups=1)
    for g in range(1, 9):
        changes += [(g, f"g{g}n{k}", f"d{k % 2}", k // 2 + 1) for k in range(2)]
        edges += [(g, f"g{g}n{k}", f"g{g}n{k - 1}") for k in range(1, 2)]
    sizes, own = [], G.asof
    causal = G.Causal(*frames(spark, changes, edges))
    causal.__dict__["lifts"] = causal.lifts[:1]  # without the long paths there are many rounds
    monkeypatch.setattr(G, "asof", lambda jumps, asked: sizes.append(asked.select("group_id").distinct().count()) or own(jumps, asked))
    found = {(r.group_id, r.change_hash): r.lamport for r in causal.lamports.collect()}
    wanted = {}
    for g, name, _, _ in sorted(changes, key=lambda c: (c[0], int(c[1].split("n")[1]))):
        wanted[g, name] = 1 + max((wanted[g, p] for h, c, p in edges if (h, c) == (g, name)), default=0)
    assert found == wanted
    assert min(sizes) <= 1


def test_parents_in_the_chain_are_not_met_again(spark):
    changes, edges = frames(spark, [(1, f"n{k}", "d", k) for k in range(5)] + [(1, "m", "e", 1)], [(1, f"n{k}", f"n{k - 1}") for k in range(1, 5)] + [(1, "n3", "m"), (1, "m", "lost")])
    assert {r.change_hash: r.others for r in G.in_chains(changes, edges).collect() if r.others} == {"n3": ["m"], "m": ["lost"]}


def test_a_bag_differs_as_often_as_it_lacks_rows(spark):
    one, two = (spark.createDataFrame(x, "a int, b string") for x in ([(1, "x")] * 3 + [(2, None)], [(1, "x"), (2, None), (2, None), (3, "y")]))
    assert sorted(map(str, H.difference(one, two).collect())) == sorted(map(str, one.exceptAll(two).selectExpr("*", "'missing' AS side").union(two.exceptAll(one).selectExpr("*", "'extra' AS side")).collect()))


@pytest.mark.parametrize("name", ["gr7_path_resolution", "gr7_conflict_copies", "tk1_total_order"])
def test_hashes_do_not_travel(spark, name):
    """Above the deal there are no more exchanges, and below it no hashes of changes."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") == 1 and "sha2" in plan.split("Exchange")[0] and "sha2(cast(change_hash" not in plan.split("Exchange")[1]


def arrivals(spark, seed: int, groups: int = 2):
    changes, edges = history(seed, groups=groups)
    rng, order = random.Random(seed), {}
    received = [(*c, order.setdefault(c[0], iter(rng.sample(range(100), 100))).__next__()) for c in changes if rng.random() < 0.9]
    return spark.createDataFrame(received, "group_id long, change_hash string, device_id string, seq long, received_seq long"), frames(spark, changes, edges)[1]


@pytest.mark.parametrize("most", [3, 1000])
def test_held_orphans_are_those_of_the_buffer(spark, most):
    received, edges = arrivals(spark, 4)
    one = received.filter("group_id = 1 AND received_seq < 3")  # a group that is never crowded, beside one that is
    received = received.filter("group_id = 0").unionByName(one)
    wanted = R.bounded_buffer(received, edges, most).filter("state = 'orphan'").select("group_id", "change_hash", "received_seq")
    found = R.held_orphans(received, edges, most)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect())) != []


def test_groups_that_can_not_overflow_need_no_times(spark, monkeypatch):
    calls, own = [], R.complete_at
    monkeypatch.setattr(R, "complete_at", lambda *a: calls.append(1) or own(*a))
    assert QUERIES["tk3_orphan_bound"](spark, FOLDER).count() > 0 and not calls
    assert R.held_orphans(*arrivals(spark, 4), 3).count() > 0 and calls


def test_groups_that_have_seen_all_are_not_asked_again(spark, monkeypatch):
    """One history over many chains beside short ones, which end after a round."""
    changes = [(0, f"c{k}", f"d{k}", 1) for k in range(12)]
    edges = [(0, f"c{k}", f"c{k - 1}") for k in range(1, 12)]
    for g in range(1, 9):
        changes += [(g, f"g{g}a", "x", 1), (g, f"g{g}b", "y", 1)]
        edges += [(g, f"g{g}b", f"g{g}a")]
    sizes, own = [], G.asof
    causal = G.Causal(*frames(spark, changes, edges))
    monkeypatch.setattr(G, "asof", lambda jumps, asked: sizes.append(asked.select("group_id").distinct().count()) or own(jumps, asked))
    reach = {(r.group_id, r.device, r["of"]) for r in causal.reach.collect()}
    assert sizes[0] == 9 and sizes[-1] == 1
    assert sorted(map(tuple, causal.pairs().collect())) == sorted((r.group_id, r.change_hash, r.ancestor) for r in G.ancestors(frames(spark, changes, edges)[1]).collect())
    assert len(reach) == 12 * 11 // 2 + 8


@pytest.mark.parametrize("name", ["fx_changes", "fx_received"])
def test_numbered_views_deal_events_once(spark, name):
    plan = getattr(Views(spark, FOLDER).numbered, name)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "sha2" not in plan.split("Exchange")[1]
