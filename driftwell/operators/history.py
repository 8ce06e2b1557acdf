"""Audits, plans and orders over changes, built on the graph operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.paths import lint
from driftwell.operators.graph import Causal
from driftwell.plans.lineage import cut, few

NODE = ["group_id", "change_hash"]
DAY_US = 86_400_000_000


def total_order(changes: DataFrame) -> DataFrame:
    """changes with nth, by (lamport, hash) within the group; the same for any order of arrival."""
    return changes.withColumn("nth", F.row_number().over(Window.partitionBy("group_id").orderBy("lamport", "change_hash")).cast("long"))


def explode_ops(ops: DataFrame) -> DataFrame:
    """A row per touched path; a Move deletes its source and puts its target."""
    delete = F.struct(F.col("path"), F.lit(None).cast("string").alias("version_hash"), F.lit("Delete").alias("kind"))
    put = F.struct(F.col("to_path").alias("path"), F.col("version_hash"), F.lit("Put").alias("kind"))
    same = F.struct(F.col("path"), F.when(F.col("kind") == "Put", F.col("version_hash")).alias("version_hash"), F.col("kind"))
    touched = F.when(F.col("kind") == "Move", F.array(delete, put)).otherwise(F.array(same))
    rest = [c for c in ops.columns if c not in ("path", "to_path", "version_hash", "kind")]
    return ops.select(*rest, F.explode(touched).alias("t")).select(*rest, "t.path", "t.version_hash", "t.kind")


def clamp_future(rows: DataFrame, time: str, now_us: int) -> DataFrame:
    """No time later than a day from now."""
    return rows.withColumn(time, F.least(F.col(time), F.lit(now_us + DAY_US)))


def older_loses() -> Column:
    """Of a and b (with a_mtime, a_device and so on): the older one; of equal times, the smaller device."""
    return F.when(F.struct("a_mtime", "a_device") < F.struct("b_mtime", "b_device"), "a").otherwise("b")


def required_copies(copies: DataFrame, heads: DataFrame, touches: DataFrame, causal: Causal) -> DataFrame:
    """copies (with target) that are still wanted: their content does not live at the target, and nothing at or after the loser acted on the target."""
    there = heads.filter(F.col("version_hash").isNotNull()).select("group_id", F.col("path").alias("target"), "version_hash")
    keys = ["group_id", "target", "losing_change"]
    targets = few(cut(copies.select("group_id", "target").distinct()))
    after = cut(touches.select("group_id", F.col("path").alias("target"), "change_hash").join(targets, ["group_id", "target"], "left_semi"))
    upto = causal.seen_by(after).groupBy("group_id", "target", "chain").agg(F.max("upto").alias("upto"))
    losers = copies.join(causal.own.select("group_id", F.col("change_hash").alias("losing_change"), "chain", "pos"), ["group_id", "losing_change"])
    acted = losers.join(upto, ["group_id", "target", "chain"]).filter("pos <= upto").select(*keys)
    left = copies.join(there, ["group_id", "target", "version_hash"], "left_anti").join(acted, keys, "left_anti")
    return left.select("group_id", "path", "losing_change", "version_hash", "target")


def audit_claims(claims: DataFrame, heads: DataFrame, copies: DataFrame) -> DataFrame:
    """Verdict on each claim that a change lost a path with a version."""
    live = heads.select("group_id", "path", F.col("change_hash").alias("losing_change"), F.col("version_hash").alias("own"), F.lit(True).alias("live"))
    lost = copies.select("group_id", "path", "losing_change", F.lit(True).alias("lost"))
    keys = ["group_id", "path", "losing_change"]
    joined = claims.join(live, keys, "left").join(lost, keys, "left")
    verdict = F.when(F.col("live").isNull(), "not a live head").when(F.col("own").isNull(), "no content").when(~F.col("own").eqNullSafe(F.col("version_hash")), "other version").when(F.col("lost").isNull(), "not a loser").otherwise("ok")
    return joined.select(*keys, verdict.alias("verdict"))


def difference(required: DataFrame, claimed: DataFrame) -> DataFrame:
    """Rows of one bag that the other lacks, as often as it lacks them, with side: missing or extra."""
    both = required.withColumn("_n", F.lit(1)).unionByName(claimed.withColumn("_n", F.lit(-1)))
    net = both.groupBy(*required.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    side = F.when(F.col("_n") > 0, "missing").otherwise("extra").alias("side")
    return net.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n")))).select(*required.columns, side)


def fit_budget(items: DataFrame, order: str, budget: dict[str, int]) -> DataFrame:
    """Items of each group, in order, until one does not fit any more; those that never fit are left out before."""
    within = Window.partitionBy("group_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    possible = items
    for name, most in budget.items():
        possible = possible.filter(F.col(name) <= most)
    fits = F.lit(True)
    for name, most in budget.items():
        fits = fits & (F.sum(name).over(within) <= most)
    return possible.withColumn("_fits", fits).filter("_fits").drop("_fits")


def supersession(asked: DataFrame, plan: DataFrame, changes: DataFrame) -> DataFrame:
    """Whether a checkpoint supersedes a hash; what nobody knows is unknown, not pruned."""
    has = plan.select("group_id").distinct().withColumn("has", F.lit(True))
    out = asked.join(has, "group_id", "left").join(plan, NODE, "left").join(changes.select(*NODE, F.lit(True).alias("known")), NODE, "left")
    return out.select(*NODE, F.when(F.col("has").isNull(), "no checkpoint").when(F.col("role") == "pruned", "superseded").when(F.col("known"), "present").otherwise("unknown").alias("verdict"))


def apply_prune(changes: DataFrame, plan: DataFrame) -> DataFrame:
    """changes with stub: pruned ones keep only their identity."""
    return changes.join(plan, NODE, "left").withColumn("stub", F.col("role").eqNullSafe(F.lit("pruned"))).drop("role")


def audit_snapshot(snapshot: DataFrame, frontier: DataFrame) -> DataFrame:
    """Per group: how many changes each side has, and how many only one has."""
    both = frontier.withColumn("c", F.lit(1)).join(snapshot.withColumn("s", F.lit(1)), NODE, "full_outer")
    return both.groupBy("group_id").agg(F.count("c").alias("in_checkpoint"), F.count("s").alias("in_snapshot"), F.count_if(F.col("c").isNull() | F.col("s").isNull()).alias("differs"))


def audit_history(kept: DataFrame, edges: DataFrame, pruned_edges: DataFrame) -> DataFrame:
    """Parents that retained changes name and that are not there, and whether pruned edges prove them."""
    own = edges.join(kept.select("group_id", F.col("change_hash").alias("child_hash")), ["group_id", "child_hash"], "left_semi")
    gone = own.join(kept.select("group_id", F.col("change_hash").alias("parent_hash")), ["group_id", "parent_hash"], "left_anti")
    proof = pruned_edges.select("group_id", "parent_hash").distinct().withColumn("proof", F.lit(True))
    return gone.join(proof, ["group_id", "parent_hash"], "left").select("group_id", F.col("child_hash").alias("change_hash"), F.col("parent_hash").alias("missing"), F.coalesce("proof", F.lit(False)).alias("proven"))


def lamport_mismatches(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """Changes whose lamport is not one more than the greatest of their parents."""
    parents = edges.join(changes.select("group_id", F.col("change_hash").alias("parent_hash"), F.col("lamport").alias("above")), ["group_id", "parent_hash"]).groupBy("group_id", F.col("child_hash").alias("change_hash")).agg(F.max("above").alias("above"))
    out = changes.join(parents, NODE, "left").withColumn("expected", F.coalesce("above", F.lit(0)) + 1)
    return out.filter("lamport <> expected").select(*NODE, "lamport", "expected")


def batch_plan(paths: DataFrame, touches: DataFrame, order: str) -> DataFrame:
    """The last change of a batch on each path; the zero hash where it has none."""
    last = touches.groupBy("group_id", "path").agg(F.max_by("change_hash", order).alias("last"))
    return paths.join(last, ["group_id", "path"], "left").select("group_id", "path", F.coalesce("last", F.lit("0" * 64)).alias("change_hash"))


def auth_monotonicity(auth: DataFrame, edges: DataFrame, readable: DataFrame) -> DataFrame:
    """Whether a change's authority is at least that of all its parents; hold where one cannot be read."""
    up = edges.join(readable.select("group_id", F.col("change_hash").alias("parent_hash"), F.col("auth_seq").alias("s"), F.col("auth_epoch").alias("e")), ["group_id", "parent_hash"], "left")
    most = up.groupBy("group_id", F.col("child_hash").alias("change_hash")).agg(F.max("s").alias("s"), F.max("e").alias("e"), F.bool_or(F.col("s").isNull()).alias("hold"))
    out = auth.join(most, NODE, "left")
    return out.select(*NODE, F.when(F.col("hold"), "hold").when((F.col("auth_seq") < F.col("s")) | (F.col("auth_epoch") < F.col("e")), "regressed").otherwise("ok").alias("verdict"))


def audit_structure(changes: DataFrame) -> DataFrame:
    """Verdict on a change with parents (in stored order), kind, path and to_path."""
    sorted_ = F.col("parents") == F.sort_array(F.array_distinct("parents"))
    verdict = F.when(F.col("parents").isNotNull() & ~sorted_, "parents not ascending").when(F.array_contains("parents", F.col("change_hash")), "own parent").when((F.col("kind") == "Move") & (F.col("path") == F.col("to_path")), "move onto itself").otherwise("ok")
    return changes.select("change_hash", verdict.alias("verdict"))


#: Most parents and ops of a change, and the order of the kinds of op on one path.
MOST_PARENTS, MOST_OPS = 1024, 1 << 16
KINDS = ("Put", "Delete", "Move")


def audit_changes(changes: DataFrame, most_parents: int = MOST_PARENTS, most_ops: int = MOST_OPS) -> DataFrame:
    """(change_hash, verdict) of changes(change_hash, parents, ops, obligations): the first rule that a change breaks, or ok.

    parents: hashes in stored order. ops: (kind, path, to_path, source_path) in stored order; source_path is set where a put is
    a conflict copy. obligations: source paths that a repair is for; null if the change is no repair. A Move acts on both its
    paths. Paths are judged by the path lint, without its reserved names.
    """
    ascending = lambda a: F.coalesce(a == F.array_sort(F.array_distinct(a)), F.lit(True))
    nth = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keys = F.transform("ops", lambda o: F.struct(o["path"].alias("path"), nth[o["kind"]].alias("nth")))
    touched = F.flatten(F.transform("ops", lambda o: F.when(o["kind"] == "Move", F.array(o["path"], o["to_path"])).otherwise(F.array(o["path"]))))
    named = F.concat(touched, F.filter(F.transform("ops", lambda o: o["source_path"]), lambda p: p.isNotNull()), F.coalesce("obligations", F.array().cast("array<string>")))
    bad = F.exists(named, lambda p: (lint(p, ()) != "ok"))
    rules = [
        (F.size("parents") > most_parents, "too many parents"),
        (~ascending(F.col("parents")), "parents not ascending"),
        (F.array_contains("parents", F.col("change_hash")), "own parent"),
        (F.size("ops") > most_ops, "too many ops"),
        (F.size("obligations") == 0, "repair without obligations"),
        (F.size("obligations") > most_ops, "too many obligations"),
        (~ascending(F.col("obligations")), "obligations not ascending"),
        (keys != F.array_sort(keys), "ops not in order"),
        (F.exists("ops", lambda o: (o["kind"] == "Move") & (o["path"] == o["to_path"])), "move onto itself"),
        (F.exists("ops", lambda o: o["source_path"] == o["path"]), "copy of itself"),
        (F.size(touched) > F.size(F.array_distinct(touched)), "path twice"),
        (bad, "bad path"),
    ]
    verdict = F.lit("ok")
    for broken, name in reversed(rules):
        verdict = F.when(broken, name).otherwise(verdict)
    return changes.select("change_hash", verdict.alias("verdict"))
