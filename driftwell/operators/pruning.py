"""Pruned histories: a new snapshot beside the old one, and audits of what it holds.

Nothing is changed in place. `pruned` derives the parts of the snapshot after a prune; `write` puts them into a folder of
their own with a manifest of row counts and digests, and a snapshot counts only once its manifest is there, so a lost
executor or a second run leaves the old one whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators import merkle
from driftwell.operators.graph import NODE, Causal
from driftwell.plans.lineage import cut

#: What identifies a row of each part.
PARTS = {"changes": ["change_hash"], "edges": ["child_hash", "parent_hash"], "references": ["change_hash", "version_hash"], "versions": ["version_hash"], "stubs": ["change_hash", "lamport"], "boundary": ["child_hash", "parent_hash"], "heads": ["change_hash"]}


@dataclass
class Snapshot:
    """changes and heads (NODE, ...); edges and boundary (group_id, child_hash, parent_hash); references (NODE, version_hash);
    versions (group_id, version_hash); stubs (NODE, device_id, seq, lamport, parents)."""

    changes: DataFrame
    edges: DataFrame
    references: DataFrame
    versions: DataFrame
    stubs: DataFrame
    boundary: DataFrame
    heads: DataFrame


def trashed(touches: DataFrame) -> DataFrame:
    """touches(group_id, path, us, event_id, kind, version_hash, ...) with authorized: whether a delete of the path follows right after a version."""
    along = Window.partitionBy("group_id", "path").orderBy("us", "event_id")
    deleted = F.col("kind") == "Delete"
    return touches.withColumn("authorized", ~deleted & F.coalesce(F.lead(deleted).over(along), F.lit(False)))


def versions_left(references: DataFrame, plan: DataFrame, roots: DataFrame) -> DataFrame:
    """(group_id, version_hash, left, authorized) of the versions of references(NODE, version_hash, authorized), in one pass over them.

    left: a change references it that the plan does not prune or that a root keeps. References may come several times.
    """
    gone = plan.filter("role = 'pruned'").select(*NODE).join(roots.select(*NODE), NODE, "left_anti").withColumn("_gone", F.lit(True))
    rows = references.select(*NODE, "version_hash", "authorized").join(gone, NODE, "left")
    return rows.groupBy("group_id", "version_hash").agg(F.bool_or(F.col("_gone").isNull()).alias("left"), F.bool_or("authorized").alias("authorized"))


def authorized_blocks(asked: DataFrame, version_blocks: DataFrame, references: DataFrame, authorized: DataFrame) -> DataFrame:
    """asked(group_id, hash) with verdict: retained if a version that the group's changes reference has the block, compaction
    if only one that a compaction authorized in the group has it, else refused. Other groups' versions give no right."""
    named = references.select("group_id", "version_hash", F.lit(True).alias("_held")).unionByName(authorized.select("group_id", "version_hash"), allowMissingColumns=True)
    given = named.groupBy("group_id", "version_hash").agg(F.coalesce(F.max("_held"), F.lit(False)).alias("_held"))
    blocks = given.join(version_blocks.select("version_hash", "hash").distinct(), "version_hash").groupBy("group_id", "hash").agg(F.max("_held").alias("_held"))
    rows = asked.join(blocks, ["group_id", "hash"], "left")
    return rows.select(*asked.columns, F.when(F.col("_held"), "retained").when(~F.col("_held"), "compaction").otherwise("refused").alias("verdict"))


def pruned(changes: DataFrame, edges: DataFrame, references: DataFrame, plan: DataFrame, roots: DataFrame, authorized: DataFrame, lamports: DataFrame) -> Snapshot:
    """The snapshot after a plan(NODE, role). roots(NODE) keep their payload; authorized(group_id, version_hash) stay anyway.

    Of a pruned change without a root its body, its edges to both sides, and its references go; a stub with its device, sequence
    number, parents and Lamport number stays. Versions go that neither a reference left nor an authorization names. Edges from what stays to what
    went are the boundary, the proof that a missing parent was pruned and not lost.
    """
    gone = cut(plan.filter("role = 'pruned'").select(*NODE).join(roots.select(*NODE), NODE, "left_anti"))
    identity = changes.select(*NODE, "device_id", F.col("seq").cast("long").alias("seq"))
    as_child, as_parent = gone.withColumnRenamed("change_hash", "child_hash"), gone.withColumnRenamed("change_hash", "parent_hash")
    from_kept = edges.join(as_child, ["group_id", "child_hash"], "left_anti")
    parents = edges.join(as_child, ["group_id", "child_hash"], "left_semi").groupBy("group_id", F.col("child_hash").alias("change_hash")).agg(F.array_sort(F.collect_set("parent_hash")).alias("parents"))
    left = references.join(gone, NODE, "left_anti")
    versions = left.select("group_id", "version_hash").unionByName(authorized.select("group_id", "version_hash")).distinct()
    superseded = edges.select("group_id", F.col("parent_hash").alias("change_hash")).distinct()
    return Snapshot(
        changes=changes.join(gone, NODE, "left_anti"),
        edges=from_kept.join(as_parent, ["group_id", "parent_hash"], "left_anti"),
        references=left,
        versions=versions,
        stubs=gone.join(identity, NODE).join(lamports, NODE).join(parents, NODE, "left").select(*NODE, "device_id", "seq", "lamport", F.coalesce("parents", F.array().cast(parents.schema["parents"].dataType)).alias("parents")),
        boundary=from_kept.join(as_parent, ["group_id", "parent_hash"], "left_semi"),
        heads=changes.join(superseded, NODE, "left_anti").join(gone, NODE, "left_anti").select(*NODE),
    )


def write(snapshot: Snapshot, folder: str) -> DataFrame:
    """Writes the parts, then the manifest (group_id, part, n, digest), and returns it."""
    spark = snapshot.changes.sparkSession
    for part in PARTS:
        getattr(snapshot, part).write.parquet(f"{folder}/{part}")
    manifest = manifest_of(read_back(spark, folder))
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_back(spark, folder: str) -> Snapshot:  # noqa: ANN001
    return Snapshot(**{part: spark.read.parquet(f"{folder}/{part}") for part in PARTS})


def manifest_of(snapshot: Snapshot) -> DataFrame:
    """(group_id, part, n, digest), by one Merkle tree for each group and part."""
    items = None
    for part, columns in PARTS.items():
        own = merkle.packed_items(getattr(snapshot, part).withColumn("part", F.lit(part)), ["group_id", "part"], *columns)
        items = own if items is None else items.unionByName(own)
    nodes = merkle.packed_tree(items, ["group_id", "part"])
    return nodes.filter("prefix = ''").select("group_id", "part", "n", "digest")


def audit_checkpoint(snapshot: Snapshot, manifest: DataFrame, frontier: DataFrame) -> DataFrame:
    """(group_id, parts_differ, frontier_differs, missing_versions) of every group of the manifest or the checkpoint's frontier(NODE).

    parts_differ: parts whose digest is another than the manifest says. frontier_differs: hashes that only one of the
    checkpoint's frontier and the snapshot's changes at the frontier has. missing_versions: referenced, but not there.
    """
    now = manifest_of(snapshot).select("group_id", "part", F.col("digest").alias("_now"))
    parts = manifest.join(now, ["group_id", "part"], "full_outer").groupBy("group_id").agg(F.count_if(~F.col("digest").eqNullSafe(F.col("_now"))).alias("parts_differ"))
    lost = frontier.join(snapshot.changes.select(*NODE), NODE, "left_anti").groupBy("group_id").agg(F.count("*").alias("frontier_differs"))
    missing = snapshot.references.select("group_id", "version_hash").distinct().join(snapshot.versions, ["group_id", "version_hash"], "left_anti").groupBy("group_id").agg(F.count("*").alias("missing_versions"))
    groups = parts.select("group_id").unionByName(frontier.select("group_id")).distinct()
    out = groups.join(parts, "group_id", "left").join(lost, "group_id", "left").join(missing, "group_id", "left")
    return out.select("group_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("parts_differ", "frontier_differs", "missing_versions")])


def audit_retained(snapshot: Snapshot) -> DataFrame:
    """(group_id, change_hash, verdict, n_boundary, n_unproven) of every retained change and of every head.

    verdict: reached from the heads over retained and stub edges, unreached, or missing (a head without a body). Of its
    parents that are not retained, those behind a boundary edge are proven, the others are lost history.
    """
    stub_edges = snapshot.stubs.select("group_id", F.col("change_hash").alias("child_hash"), F.explode("parents").alias("parent_hash"))
    edges = snapshot.edges.unionByName(snapshot.boundary).unionByName(stub_edges).distinct()
    stubs = snapshot.stubs.select(*NODE, "device_id", "seq")  # in their devices' chains, as the bodies are
    there = snapshot.changes.select(*NODE, "device_id", F.col("seq").cast("long").alias("seq")).unionByName(stubs)
    bodies = snapshot.changes.select(*NODE)
    heads = snapshot.heads.select(*NODE)
    reach = Causal(there, edges).closure(heads.join(bodies, NODE, "left_semi")).withColumn("_reached", F.lit(True))
    own = snapshot.edges.unionByName(snapshot.boundary).withColumnRenamed("child_hash", "change_hash")
    absent = own.join(bodies.withColumnRenamed("change_hash", "parent_hash"), ["group_id", "parent_hash"], "left_anti")
    proof = snapshot.boundary.select("group_id", F.col("child_hash").alias("change_hash"), "parent_hash", F.lit(True).alias("_proof"))
    holes = absent.join(proof, ["group_id", "change_hash", "parent_hash"], "left").groupBy(*NODE).agg(F.count("_proof").alias("n_boundary"), F.count_if(F.col("_proof").isNull()).alias("n_unproven"))
    rows = bodies.join(reach, NODE, "left").select(*NODE, F.when(F.col("_reached"), "reached").otherwise("unreached").alias("verdict"))
    rows = rows.unionByName(heads.join(bodies, NODE, "left_anti").withColumn("verdict", F.lit("missing")))
    return rows.join(holes, NODE, "left").select(*NODE, "verdict", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_boundary", "n_unproven")])
