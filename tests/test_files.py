"""A row for each branch of the block and file rules."""

from pyspark.sql import functions as F

from driftwell.operators import files as X
from driftwell.operators import history as H
from driftwell.operators import pruning as P


def test_block_lists(spark):
    rows = [(1, '[{"hash":"a","offset":0,"size":3},{"hash":"b","offset":3,"size":2}]'), (2, "[]"), (3, None), (4, "{"), (5, '[{"hash":"a","offset":0,"size":0}]'), (6, '[{"offset":0,"size":1}]'), (7, '[{"hash":"a","offset":0,"size":3},{"hash":"b","offset":4,"size":2}]'), (8, '[{"hash":"a","offset":1,"size":3}]'), (9, "7")]
    good, bad = X.expand_blocks(spark.createDataFrame(rows, "doc_id long, blocks_json string"))
    assert sorted(map(tuple, good.collect())) == [(1, 0, "a", 0, 3), (1, 1, "b", 3, 2)]
    assert {r.doc_id: r.reason for r in bad.collect()} == {3: "no list", 4: "no list of blocks", 5: "bad block", 6: "bad block", 7: "gap", 8: "gap", 9: "no list of blocks"}


def test_sweep_spares_live_and_young_blocks(spark):
    store = spark.createDataFrame([("a", 1, 0), ("b", 2, 400_000_000), ("c", 3, 400_000_001), ("d", 4, 2_000_000_000), ("e", 5, 0)], "hash string, size long, us long")
    found = X.sweep(store, spark.createDataFrame([("a",), ("a",), ("z",)], "hash string"), 1_000_000_000)
    assert {r["hash"]: r.verdict for r in found.collect()} == {"a": "live", "b": "swept", "c": "young", "d": "young", "e": "swept"}


def test_durable_holdings(spark):
    two = [("a", 1), ("b", 2)]
    asked = spark.createDataFrame([(n, "v", b) for n, b in enumerate([two, two, two, two, two[::-1], [("a", 1), ("b", 3)], two, [("a", 1), ("x", 1)], [("a", 1), ("t", 1)], []])], "file long, version string, blocks array<struct<hash:string,size:bigint>>")
    index = spark.createDataFrame([(n, "on_demand" if n == 1 else "eager", "evicting" if n == 3 else "pinned", None if n == 2 else "v") for n in range(10) if n], "file long, policy string, state string, version string")
    held = {6: two, 7: [("a", 1), ("x", 1)], 8: [("a", 1), ("t", 1)]}
    blocks = spark.createDataFrame([(n, i, h, s) for n in range(9) for i, (h, s) in enumerate(held.get(n, two))], "file long, ord long, hash string, size long")
    provenance = spark.createDataFrame([("a",), ("b",), ("t",)], "hash string")
    store = spark.createDataFrame([(h, "torn" if h == "t" else h) for h in "abxt"], "hash string, digest string")
    found = X.durable_holdings(asked, index, blocks, provenance, store)
    assert {r.file: r.verdict for r in found.collect()} == {0: "unknown", 1: "not eager", 2: "other version", 3: "not held", 4: "other blocks", 5: "other blocks", 6: "durable", 7: "no provenance", 8: "damaged", 9: "durable"}


def test_triage(spark):
    files = spark.createDataFrame([(1, f"p{n}", 5, "v" if n < 5 else "w", "current", False, "hydrated") for n in range(7)], "group_id long, path string, size long, version_hash string, state string, deleted boolean, materialization_state string")
    disk = spark.createDataFrame([(1, "p0", 5, "v"), (1, "p3", 6, "v"), (1, "p4", 5, "x"), (1, "p6", 1, "w")], "group_id long, path string, size long, hash string")
    intents = spark.createDataFrame([(1, "p2"), (1, "p5")], "group_id long, path string")
    version_blocks = spark.createDataFrame([("v", "a"), ("v", "b"), ("w", "a"), ("w", "c")], "version_hash string, hash string")
    stored = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "group_id long, hash string")
    found = X.triage(files, disk, intents, version_blocks, stored)
    assert {r.path: (r.outcome, r.quarantine) for r in found.collect()} == {"p0": ("ok", False), "p1": ("offline delete", False), "p2": ("reconstruct", False), "p3": ("reconstruct", True), "p4": ("reconstruct", True), "p5": ("demote", False), "p6": ("demote", True)}


def test_block_authorization(spark):
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "group_id long, hash string")
    version_blocks = spark.createDataFrame([("v", "a"), ("w", "b"), ("w", "a")], "version_hash string, hash string")
    left = spark.createDataFrame([(1, "x", "v")], "group_id long, change_hash string, version_hash string")
    given = spark.createDataFrame([(1, "w"), (2, "u")], "group_id long, version_hash string")
    found = P.authorized_blocks(asked, version_blocks, left, given)
    assert {(r.group_id, r["hash"]): r.verdict for r in found.collect()} == {(1, "a"): "retained", (1, "b"): "compaction", (1, "c"): "refused", (2, "a"): "refused"}


def test_pruned_snapshots(spark, tmp_path):
    """A line a-b-c-d of which a and b are pruned; b keeps its payload by a root."""
    changes = spark.createDataFrame([(1, h, "d", n + 1) for n, h in enumerate("abcd")], "group_id long, change_hash string, device_id string, seq long")
    edges = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "d", "c")], "group_id long, child_hash string, parent_hash string")
    references = spark.createDataFrame([(1, h, f"v{h}") for h in "abcd"], "group_id long, change_hash string, version_hash string")
    plan = spark.createDataFrame([(1, "a", "pruned"), (1, "b", "pruned"), (1, "c", "frontier")], "group_id long, change_hash string, role string")
    roots = spark.createDataFrame([(1, "b")], "group_id long, change_hash string")
    none = spark.createDataFrame([], "group_id long, version_hash string")
    lamports = spark.createDataFrame([(1, h, n + 1) for n, h in enumerate("abcd")], "group_id long, change_hash string, lamport long")
    snapshot = P.pruned(changes, edges, references, plan, roots, none, lamports)
    manifest = P.write(snapshot, str(tmp_path / "s"))
    assert {r.part: r.n for r in manifest.collect()} == {"changes": 3, "edges": 2, "references": 3, "versions": 3, "stubs": 1, "boundary": 1, "heads": 1}
    back = P.read_back(spark, str(tmp_path / "s"))
    frontier = spark.createDataFrame([(1, "c")], "group_id long, change_hash string")
    assert [tuple(r) for r in P.audit_checkpoint(back, manifest, frontier).collect()] == [(1, 0, 0, 0)]
    assert {r.change_hash: (r.verdict, r.n_boundary, r.n_unproven) for r in P.audit_retained(back).collect()} == {"b": ("reached", 1, 0), "c": ("reached", 0, 0), "d": ("reached", 0, 0)}
    back.changes = back.changes.filter(F.col("change_hash") != "c")
    assert {r.change_hash: (r.verdict, r.n_boundary, r.n_unproven) for r in P.audit_retained(back).collect()} == {"b": ("unreached", 1, 0), "d": ("reached", 0, 1)}
    assert [tuple(r) for r in P.audit_checkpoint(back, manifest, frontier).collect()] == [(1, 1, 1, 0)]


def test_every_rule_of_a_change(spark):
    put = lambda p, source=None: ("Put", p, None, source)
    rows = [
        ("ok", ["a", "b"], [put("a"), ("Move", "b", "c", None), ("Delete", "d", None, None)], ["x", "y"], "ok"),
        ("none", [], [], None, "ok"),
        ("many", ["a", "b", "c", "d"], [], None, "too many parents"),
        ("down", ["b", "a"], [], None, "parents not ascending"),
        ("twin", ["a", "a"], [], None, "parents not ascending"),
        ("self", ["self"], [], None, "own parent"),
        ("ops", [], [put(f"p{i}") for i in range(5)], None, "too many ops"),
        ("empty", [], [], [], "repair without obligations"),
        ("long", [], [], list("abcde"), "too many obligations"),
        ("turned", [], [], ["b", "a"], "obligations not ascending"),
        ("order", [], [put("b"), put("a")], None, "ops not in order"),
        ("kinds", [], [("Delete", "a", None, None), put("a")], None, "ops not in order"),
        ("stay", [], [("Move", "a", "a", None)], None, "move onto itself"),
        ("copy", [], [put("a", "a")], None, "copy of itself"),
        ("twice", [], [put("a"), ("Delete", "a", None, None)], None, "path twice"),
        ("onto", [], [("Move", "a", "b", None), put("b")], None, "path twice"),
        ("path", [], [put("a/../b")], None, "bad path"),
        ("source", [], [put("a", "/b")], None, "bad path"),
        ("goal", [], [], ["C:x"], "bad path"),
    ]
    table = spark.createDataFrame([r[:4] for r in rows], "change_hash string, parents array<string>, ops array<struct<kind:string,path:string,to_path:string,source_path:string>>, obligations array<string>")
    assert {r.change_hash: r.verdict for r in H.audit_changes(table, 3, 4).collect()} == {r[0]: r[4] for r in rows}
