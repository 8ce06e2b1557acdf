"""Edge rules of single operators, on small hand-made or random inputs."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftwell.functions import paths as P
from driftwell.operators import files as X
from driftwell.operators import fleet as O
from driftwell.operators import graph as G
from driftwell.plans.lineage import cut
from driftwell.sources import sinks as K
from driftwell.streaming import sessions as S


def random_history(seed, chains, n=25):
    """With chains, each of three devices has its last change among the parents of its next."""
    rng = random.Random(seed)
    changes, edges, touches, parents = [], [], [], {}
    for i in range(n):
        mine = sorted(rng.sample(range(i), min(i, rng.choice([0, 1, 1, 2]))))
        own = [j for j in range(i) if j % 3 == i % 3]
        if chains and own:
            mine = sorted({*mine, own[-1]})
        parents[i] = mine
        changes.append((1, f"c{i:02}", f"d{i % 3}", i // 3 + 1))
        edges += [(1, f"c{i:02}", f"c{p:02}") for p in mine]
        touches.append((1, f"c{i:02}", f"p{rng.randint(0, 3)}", rng.choice([None, "v1", "v2", "v3"])))
    return changes, edges, touches, parents


def fold(changes, touches, parents):
    """A second model of path resolution, by sets."""
    up, clock = {}, {}
    for i in range(len(changes)):
        up[i] = set().union(*[up[p] | {p} for p in parents[i]]) if parents[i] else set()
        clock[i] = 1 + max((clock[p] for p in parents[i]), default=0)
    out = {}
    for path in {t[2] for t in touches}:
        own = [i for i, t in enumerate(touches) if t[2] == path]
        heads = [i for i in own if not any(i in up[j] for j in own)]
        best = {}
        for i in heads:
            if touches[i][3]:
                best[touches[i][3]] = max(best.get(touches[i][3], (0, "")), (clock[i], f"c{i:02}"))
        top = max(((b, v) for v, b in best.items()), default=None)
        out[path] = (top[0][1] if top else None, top[1] if top else None, len(heads), max(len(best) - 1, 0))
    return out


@pytest.mark.parametrize("seed,chains", [(0, False), (1, True), (2, True)])
def test_resolution_is_the_same_in_any_order(spark, seed, chains):
    changes, edges, touches, parents = random_history(seed, chains)
    wanted = fold(changes, touches, parents)
    for shuffle in (1, 2):
        rng = random.Random(shuffle)
        c, e, t = (rng.sample(x, len(x)) for x in (changes, edges, touches))
        cs = spark.createDataFrame(c, "group_id long, change_hash string, device_id string, seq long")
        es = spark.createDataFrame(e, "group_id long, child_hash string, parent_hash string")
        ts = spark.createDataFrame(t, "group_id long, change_hash string, path string, version_hash string")
        causal = G.Causal(cs, es)
        assert (causal.own.select("chain").distinct().count() == 3) == chains
        heads = causal.path_heads(ts).join(causal.lamports, G.NODE)
        found = {r.path: (r.winner, r.winner_version, r.n_heads, r.n_copies) for r in G.resolve(heads).collect()}
        assert found == wanted
        reach = {(r.ancestor, r.change_hash) for r in G.ancestors(es).collect()}
        every = cs.select("group_id", F.col("change_hash").alias("a")).join(cs.select("group_id", F.col("change_hash").alias("b")), "group_id")
        assert {(r.a, r.b) for r in causal.precedes(every).filter("precedes").collect()} == reach


@pytest.mark.parametrize(
    "path,verdict",
    [("", "empty"), ("a" * 4097, "too long"), ("a\0b", "NUL"), ("a\\b", "backslash"), ("/a", "absolute"), (".syncignore", "reserved"), ("C:x", "drive"), ("a/" * 255 + "a", "too many segments"), ("a//b", "empty segment"), ("a/../b", "dot segment"), ("a/b.txt", "ok")],
)
def test_path_lint(spark, path, verdict):
    assert spark.createDataFrame([(path,)], "p string").select(P.lint(F.col("p"))).first()[0] == verdict


def test_ignore_rules(spark):
    rules = ["*.log", "/build", "docs/**/x?", "!keep.log", "tmp/", "(?i)readme"]
    cases = {"a.log": True, "d/a.log": True, "keep.log": False, "build/o": True, "s/build": True, "docs/x1": True, "docs/a/b/x1": True, "docs/a/x12": False, "tmp/f": True, "tmp": False, "d/README": True, "plain": False}
    found = {r.p: r.i for r in spark.createDataFrame([(p,) for p in cases], "p string").select("p", P.ignored(F.col("p"), rules).alias("i")).collect()}
    assert found == cases


def test_conflict_names(spark):
    rows = spark.createDataFrame([("dir/a.tar.gz",), ("noext",), (".hidden",)], "p string")
    once = P.copy_path(F.col("p"), F.lit(1704164645_000000001), F.lit("d1"), F.lit("0123456789"))
    out = rows.select("p", once.alias("c")).withColumn("again", P.copy_path(F.col("c"), F.lit(1704164645_000000001), F.lit("d1"), F.lit("0123456789"))).withColumn("source", P.source_path(F.col("c"))).withColumn("copy", P.is_copy(F.col("c"))).collect()
    assert out[0].c == "dir/a.tar (conflicted copy, 2024-01-02-030405, d1, 01234567).gz"
    assert all(r.again == r.c and r.source == r.p and r.copy for r in out)


def test_redaction_is_idempotent(spark):
    text = "mail a.b@example.org from 10.1.2.3 at /home/bob/x and /srv/data/file key -----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----"
    once = P.redact(F.col("t"))[0]
    row = spark.createDataFrame([(text,)], "t string").select(once.alias("t")).withColumn("again", P.redact(F.col("t"))[0]).first()
    assert row.t == row.again and "example.org" not in row.t and "<ip-address>" in row.t and "<private-key-block>" in row.t


def test_packing_bounds(spark):
    items = spark.createDataFrame([(1, f"p{i:02}", c) for i, c in enumerate([5, 5, 5, 100, 1, 1, 1, 1])], "plan long, path string, cost long")
    found = [r["slice"] for r in O.pack(items, ["plan"], "path", "cost", most_items=3, most_cost=12).orderBy("path").collect()]
    assert found == [0, 0, 1, 2, 3, 3, 3, 4]
    spent = items.withColumn("epochs", F.lit(64))
    assert [r["slice"] for r in O.pack(spent, ["plan"], "path", "cost", epochs="epochs").orderBy("path").collect()] == [0, 0, 1, 1, 2, 2, 3, 3]


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_against_a_fold(spark, seed):
    """Units of several paths, zero costs, units beyond every bound, plans of one unit and of hundreds."""
    rng = random.Random(seed)
    rows = [(plan, f"p{i:04}", rng.choice([0, 1, 5, 9, 40]), rng.choice([1, 1, 2]), f"u{i // rng.choice([1, 1, 3, 9]):04}") for plan, n in ((1, 300), (2, 1), (3, 40)) for i in range(n)]
    items = spark.createDataFrame(rows, "plan long, path string, cost long, epochs long, unit string")
    found = {(r.plan, r.path): r["slice"] for r in O.pack(items, ["plan"], "path", "cost", most_items=7, most_cost=30, epochs="epochs", most_epochs=9, unit="unit").collect()}
    wanted = {}
    for plan in (1, 2, 3):
        units = {}
        for r in rows:
            if r[0] == plan:
                units.setdefault(r[4], []).append(r)
        at, n, c, e = 0, 0, 0, 0
        for own in sorted(units.values(), key=lambda u: (min(r[1] for r in u), u[0][4])):
            more = len(own), sum(r[2] for r in own), sum(r[3] for r in own)
            if n and (n + more[0] > 7 or c + more[1] > 30 or e + more[2] > 9):
                at, n, c, e = at + 1, 0, 0, 0
            n, c, e = n + more[0], c + more[1], e + more[2]
            wanted |= {(plan, r[1]): at for r in own}
    assert found == wanted and max(found.values()) > 40


def test_chunks_survive_insertions(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij ") for _ in range(20000))
    rows = spark.createDataFrame([(1, text), (2, text[:5000] + "INSERTED" + text[5000:]), (3, ""), (4, None)], "doc_id long, text string")
    chunks = O.content_chunks(rows, 128, 512, 2048)
    by = {d: {r.hash for r in chunks.filter(f"doc_id = {d}").collect()} for d in (1, 2)}
    assert len(by[1] & by[2]) > 0.8 * len(by[1])
    assert chunks.filter("doc_id > 2").isEmpty() and chunks.filter("doc_id = 1").agg(F.sum("size")).first()[0] == 20000


def session_rows():
    rng = random.Random(9)
    at, rows = 0, []
    for i in range(200):
        at += rng.choice([10_000, 100_000, 250_000, 400_000])
        rows.append((i % 3, at, i, f"p{i % 4}", rng.choice(["Modified", "Removed"])))
    return rows


def test_streamed_sessions_equal_the_batch(spark, tmp_path):
    schema = "group_id long, us long, event_id long, path string, kind string"
    rows = session_rows()
    for n in range(4):
        pd.DataFrame(rows[n * 50 : n * 50 + 50], columns=["group_id", "us", "event_id", "path", "kind"]).to_parquet(tmp_path / f"{n}.parquet")
    # An event of another group, much later, moves the watermark: timers close all sessions but its own.
    pd.DataFrame([(9, rows[-1][1] + 3_600_000_000, 999, "p", "Modified")], columns=["group_id", "us", "event_id", "path", "kind"]).to_parquet(tmp_path / "4.parquet")
    wanted = sorted(tuple(r) for r in S.debounce(spark.createDataFrame(rows, schema)).collect())
    for n in range(5):
        os.utime(tmp_path / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    found = sorted(tuple(r) for r in S.collected(S.debounce_stream(stream), spark).collect())
    assert found == wanted


def as_stream(spark, folder, frame, parts=3):
    """frame, which is written in parts, as a stream of one part a batch."""
    rows = frame.toPandas()
    folder.mkdir()
    for n in range(parts):
        rows.iloc[n::parts].to_parquet(folder / f"{n}.parquet")
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def same(a, b):
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def test_streams_equal_their_twins(spark, tmp_path):
    rng = random.Random(3)
    events = spark.createDataFrame([(i % 2, f"p{i % 5}", rng.choice(["Modified", "Removed"]), i * 10, i) for i in range(40)], "group_id long, path string, kind string, us long, event_id long")
    same(S.dirty_journal(as_stream(spark, tmp_path / "a", events), spark), S.upsert_dirty(None, events))
    leases = spark.createDataFrame([(1, f"p{i % 4}", 1, i * 50_000_000, rng.choice([0, 10, 100_000_000])) for i in range(20)], "group_id long, path string, version_seq long, us long, ttl_us long")
    twin = S.lease_pins(leases, 900_000_000)
    same(S.collected(S.lease_pins(as_stream(spark, tmp_path / "b", leases), 900_000_000), spark, "complete"), twin)
    acks = spark.createDataFrame([(i % 2, f"d{i % 3}", f"h{i}", rng.randrange(10)) for i in range(20)], "group_id long, device_id string, change_hash string, us long")
    same(S.collected(S.acked_frontier(as_stream(spark, tmp_path / "c", acks)), spark, "complete"), S.acked_frontier(acks))


def test_heads_by_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(5)
    order = list(range(24))
    rng.shuffle(order)
    edges = spark.createDataFrame([(1, f"c{i}", f"c{p}") for i in range(1, 25) for p in {i - 1, i // 2} if p != i], "group_id long, child_hash string, parent_hash string")
    received = spark.createDataFrame([(1, f"c{i}", n + 1) for n, i in enumerate(order) if i != 20], "group_id long, change_hash string, received_seq long")
    heads = S.running_heads(received, edges)
    same(S.collected(S.running_heads(as_stream(spark, tmp_path / "c", received), edges), spark, "complete"), heads)
    seen = {f"c{i}": n + 1 for n, i in enumerate(order) if i != 20}
    for r in heads.collect():
        later = [seen[e.child_hash] for e in edges.filter(F.col("parent_hash") == r.change_hash).collect() if seen.get(e.child_hash, 0) > r.shown_at]
        assert r.replaced_at == min(later, default=-1)


def test_releases(spark):
    versions = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "v1.0.0", "1.0.1", "1.10.0"]
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(versions)] + [(-1, "1.0"), (-2, "01.0.0"), (-3, "1.0.0-01")], "n int, v string").withColumn("key", O.version_key(F.col("v")))
    assert [r.n for r in rows.filter("key IS NOT NULL").orderBy("key").collect()] == list(range(10)) and rows.filter("key IS NULL").count() == 3
    releases = spark.createDataFrame([("c", "p", "1.1.0", "0.1.0", 100, False, False), ("c", "p", "1.2.0", "0.5.0", 10, False, False), ("c", "k", "2.0.0", "x", 100, True, True)], "channel string, platform string, version string, minimum_version string, rollout int, kill_switch boolean, mandatory boolean")
    installs = spark.createDataFrame([(1, "c", "p", "1.0.0", 5), (2, "c", "p", "1.0.0", 50), (3, "c", "p", "0.4.0", 50), (4, "c", "k", "1.0.0", 1), (5, "c", "p", "1.2.0", 1), (6, "c", "p", "bad", 1)], "install int, channel string, platform string, version string, bucket int")
    found = {r.install: (r.offer, r.verdict) for r in O.applicable_releases(installs, releases).collect()}
    assert found == {1: ("1.2.0", "available"), 2: ("1.2.0", "held back"), 3: ("1.2.0", "available"), 4: ("2.0.0", "switched off")}


def test_cohorts_share_a_bucket(spark):
    assert O.fnv1a("") == 0xCBF29CE484222325 and O.fnv1a("a") == 0xAF63DC4C8601EC8C and O.fnv1a("foobar") == 0x85944171F73967E8
    cohorts = ["", "a", "foobar", "ring-1", "ärger", "x" * 300]
    found = {r.c: r.b for r in spark.createDataFrame([(c,) for c in cohorts], "c string").withColumn("b", O.cohort_bucket(F.col("c"))).collect()}
    assert found == {c: O.fnv1a(c) % 100 for c in cohorts}
    releases = spark.createDataFrame([("c", "p", arch, "site", "1.1.0", "0.1.0", O.fnv1a("in") % 100 + 1, False, False) for arch in "ab"], "channel string, platform string, arch string, install_source string, version string, minimum_version string, rollout int, kill_switch boolean, mandatory boolean")
    installs = spark.createDataFrame([(1, "c", "p", "a", "site", "1.0.0", 99, "in"), (2, "c", "p", "a", "site", "1.0.0", 99, None), (3, "c", "p", "x", "site", "1.0.0", 0, None), (4, "c", "p", "b", "store", "1.0.0", 0, None)], "install int, channel string, platform string, arch string, install_source string, version string, bucket int, beta_cohort string")
    assert {r.install: r.verdict for r in O.applicable_releases(installs, releases).collect()} == {1: "available", 2: "held back"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (1, "a"), (3, None)], "group_id long, x string")
    parts = K.write_snapshot({"files": rows}, str(tmp_path / "s"))
    assert [tuple(r) for r in parts["files"].collect()] == [(1, "a"), (2, "b"), (3, None)]
    assert sorted(tuple(r) for r in K.write_reports(rows, str(tmp_path / "r"), ["x"]).distinct().collect()) == [(1, "a"), (2, "b")]


def test_disk_inventory_against_index(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    none = spark.createDataFrame([], "group_id long, path string, top string")
    index, disk = cut(X.table_index(table)), X.disk_inventory(spark, str(tmp_path / "t"), "*.parquet")
    status = lambda: sorted(r.status for r in X.compare_with_disk(index, X.disk_inventory(spark, str(tmp_path / "t"), "*.parquet"), none, none, none).collect())
    assert disk.count() == index.count() and set(status()) == {"unchanged"}
    first, second = sorted((tmp_path / "t").glob("*.parquet"))[:2]
    first.unlink()
    with open(second, "ab") as f:
        f.write(b"x")
    assert status() == sorted(["tombstone", "modified"] + ["unchanged"] * (index.count() - 2))


def test_decision_table(spark):
    journal = spark.createDataFrame([(1, "enrollment", "Prepared", False, False, True, True, False, True), (2, "role_loss", "Completed", False, False, True, True, False, True), (3, "membership", "LocalSettlementPending", False, False, False, True, False, False)], "operation_id long, domain string, state string, has_link boolean, has_marker boolean, scope_known boolean, comparable boolean, joins boolean, affected_groups boolean")
    remote = spark.createDataFrame([(1, "not found"), (3, "committed"), (4, "active")], "operation_id long, status string")
    found = {r.operation_id: r.recommendation for r in O.reconcile(journal, remote).collect()}
    assert found == {1: "manual", 2: "settle", 3: "manual", 4: "manual"}
