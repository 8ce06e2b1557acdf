"""Merkle trees, interned sets and reservations against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from driftwell.operators import merkle as M
from driftwell.operators import reservations as V

ITEMS = "k long, name string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(hashes, leaf, depth=0):
    """The root of a tree over hashes, by its definition."""
    if len(hashes) <= leaf:
        return sha("leaf:" + ",".join(sorted(hashes)))
    digits = sorted({h[depth] for h in hashes})
    return sha("node:" + ",".join(d + digest([h for h in hashes if h[depth] == d], leaf, depth + 1) for d in digits))


def root(nodes):
    return {r.k: r.digest for r in M.roots(nodes, ["k"]).collect()}


def test_trees_by_definition_and_in_steps(spark):
    rng = random.Random(3)
    rows = [(1, f"a{i}") for i in range(300)] + [(2, f"b{i}") for i in range(5)] + [(3, "c")] + [(1, "a7"), (1, None)]
    items = M.hashed(spark.createDataFrame(rows, ITEMS), ["k"], "name").cache()
    wanted = {k: {sha("-" if n is None else n) for g, n in rows if g == k} for k in (1, 2, 3)}
    assert root(M.tree(items, ["k"], 4)) == {k: digest(h, 4) for k, h in wanted.items()}
    names = rng.sample(sorted({r for r in rows if r[1]}), 250)
    first = M.hashed(spark.createDataFrame(names, ITEMS), ["k"], "name").cache()
    assert root(M.added(M.tree(first, ["k"], 4), first, items, ["k"], 4)[0]) == {k: digest(h, 4) for k, h in wanted.items()}


def test_one_more_item_makes_one_branch_anew(spark):
    items = M.hashed(spark.createDataFrame([(1, f"a{i}") for i in range(500)] + [(2, "b")], ITEMS), ["k"], "name").cache()
    nodes = M.tree(items, ["k"], 4)
    for name in ("x", "y", "a7"):
        one = M.hashed(spark.createDataFrame([(1, name)], ITEMS), ["k"], "name")
        after, anew = M.added(nodes, items, one, ["k"], 4)
        assert root(after) == root(M.tree(items.unionByName(one).distinct(), ["k"], 4))
        branch = [r.prefix for r in anew.collect()]
        assert len({len(p) for p in branch}) <= 5 and len([p for p in branch if len(p) <= 1]) <= 2
        assert (name == "a7") == (not branch) and after.count() >= nodes.count()


def test_frontiers_refuse_a_path_twice(spark):
    rows = [(1, "p", ["b", "a", "b"]), (1, "q", []), (2, "p", ["a"]), (2, "r", ["c"]), (2, "p", ["a"])]
    items, errors = M.frontier_items(spark.createDataFrame(rows, "k long, path string, heads array<string>"), ["k"])
    assert {r["item"] for r in items.filter("k = 1").collect()} == {sha("p:2:a,b"), sha("q:0:")}
    assert [tuple(r) for r in errors.collect()] == [(2, "p")]


def test_interning_again_adds_nothing(spark):
    sets = spark.createDataFrame([(1, ["b", "a"]), (1, ["a", "b", "a"]), (2, ["a", "b"]), (1, [])], "group_id long, members array<string>")
    once = M.interned(None, sets, 0)
    assert once.count() == 3 and sorted(map(str, M.interned(once, sets, 1).collect())) == sorted(map(str, once.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_reservations_by_definition(spark, seed):
    rng = random.Random(seed)
    paths = ["", "a", "a/b", "a/b/c", "a/bc", "ab", "a.b", "a/b/c/d", "b", "b/é"]
    rows = [(rng.randrange(2), i, rng.choice(V.SCOPES), rng.choice(paths)) for i in range(80)]
    inside = lambda p, q: q == "" or p == q or p.startswith(q + "/")
    wanted = {}
    for g, i, s, p in rows:
        n = [0, 0, 0]
        for h, j, t, q in rows:
            meets = p == q or (t != "exact" and inside(p, q)) or (s != "exact" and inside(q, p))
            if g == h and i != j and meets and ("exclusive" in (s, t) or s == t == "exact"):
                n[0 if p == q else 1 if inside(p, q) else 2] += 1
        wanted[i] = tuple(n)
    found = V.conflicts(spark.createDataFrame(rows, "group_id long, reservation_id long, scope string, path string"))
    assert {r.reservation_id: (r.n_same, r.n_above, r.n_below) for r in found.collect()} == wanted
    assert V.conflicts(spark.createDataFrame(rows[:1], "group_id long, reservation_id long, scope string, path string")).filter(F.col("n_same") + F.col("n_above") + F.col("n_below") > 0).isEmpty()
