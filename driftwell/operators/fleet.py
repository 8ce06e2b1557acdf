"""Operators over backlogs, releases, telemetry and recovery journals."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.plans.lineage import cut, few

# Histogram edges in seconds; job transitions; backoff.
EDGES = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
TRANSITIONS = [("pending", "planning"), ("planning", "waiting"), ("planning", "fetching"), ("planning", "ready"), ("planning", "backoff"), ("planning", "done"), ("waiting", "fetching"), ("waiting", "backoff"), ("fetching", "ready"), ("fetching", "waiting"), ("fetching", "backoff"), ("backoff", "planning"), ("ready", "done"), ("waiting", "planning"), ("fetching", "planning"), ("ready", "planning"), ("planning", "planning")]
BASE_SECONDS, MOST_SECONDS = 1, 30


def fair_top(jobs: DataFrame, now_us: int, per_group: int, most: int) -> DataFrame:
    """Runnable jobs: at most per_group of each group by priority, due time and path, then the first `most` of all."""
    due = F.col("state").isin("backoff", "waiting") & (F.coalesce("next_retry_at", F.lit(0)) <= now_us)
    stale = (F.col("state") == "active") & (F.col("updated_at") < now_us - 300_000_000)
    order = [F.desc("priority"), F.col("next_retry_at").asc_nulls_first(), F.col("path").asc()]
    ranked = jobs.filter((F.col("state") == "pending") | due | stale).withColumn("nth", F.row_number().over(Window.partitionBy("group_id").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("nth") <= per_group).orderBy("nth", "group_id").limit(most)


def retry_at(attempt: Column, failed_us: Column) -> Column:
    """When to try again: base doubled with every attempt, up to the cap; no jitter."""
    wait = F.least(F.lit(float(MOST_SECONDS)), F.lit(float(BASE_SECONDS)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(10))))
    return failed_us + (wait * 1_000_000).cast("long")


def audit_transitions(steps: DataFrame) -> DataFrame:
    """steps(before, after) with allowed; leaving for superseded is always allowed, except from itself."""
    allowed = F.concat_ws(">", "before", "after").isin(*[f"{a}>{b}" for a, b in TRANSITIONS]) | ((F.col("after") == "superseded") & (F.col("before") != "superseded"))
    return steps.withColumn("allowed", allowed)


# Fixed value: the form of a semantic version, a leading v allowed.
SEMVER = "^v?(0|[1-9][0-9]*)[.](0|[1-9][0-9]*)[.](0|[1-9][0-9]*)(?:-((?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)(?:[.](?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*))*))?(?:[+][0-9A-Za-z-]+(?:[.][0-9A-Za-z-]+)*)?$"


def version_key(version: Column) -> Column:
    """An array of strings that sorts as versions do; null if malformed.

    A prerelease comes before its release; its identifiers compare one by one, numbers by value and before words.
    """
    part = lambda n: F.regexp_extract(version, SEMVER, n)
    words = F.transform(F.split(part(4), "[.]"), lambda i: F.when(i.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(i, 20, "0"))).otherwise(F.concat(F.lit("1"), i)))
    numbers = F.array(*[F.lpad(part(n), 20, "0") for n in (1, 2, 3)], F.when(part(4) == "", "1").otherwise("0"))
    return F.when(version.rlike(SEMVER), F.concat(numbers, words))


def fnv1a(text: str) -> int:
    """The 64-bit FNV-1a hash of a text's bytes."""
    h = FNV_START
    for byte in text.encode():
        h = (h ^ byte) * FNV_PRIME % (1 << 64)
    return h


# Fixed values of FNV-1a, 64 bits.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def cohort_bucket(cohort: Column) -> Column:
    """fnv1a modulo 100 as a column, on two halves of 32 bits, as a product of 64 bits would overflow."""
    low32 = (1 << 32) - 1
    data = F.encode(cohort, "UTF-8")
    bytes_ = F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    start = F.struct(F.lit(FNV_START >> 32).cast("long").alias("hi"), F.lit(FNV_START & low32).cast("long").alias("lo"))

    def step(h: Column, byte: Column) -> Column:
        # The prime is 2^40 and 435, so the product is the low half shifted by 8 in the high one, and 435 times both.
        lo = h["lo"].bitwiseXOR(byte)
        low = lo * (FNV_PRIME & low32)
        high = h["hi"] * (FNV_PRIME & low32) + F.shiftright(low, 32) + F.shiftleft(lo, 8)
        return F.struct(high.bitwiseAND(F.lit(low32)).alias("hi"), low.bitwiseAND(F.lit(low32)).alias("lo"))

    bucket = lambda h: (h["hi"] % 100 * ((1 << 32) % 100) + h["lo"] % 100) % 100
    return F.when(F.length(data) == 0, FNV_START % 100).otherwise(F.aggregate(bytes_, start, step, bucket)).cast("int")


def applicable_releases(installs: DataFrame, releases: DataFrame) -> DataFrame:
    """The newest release above each install's version, and what keeps it back; installs without one are up to date.

    Both have channel and platform, and arch and install_source where builds differ by them; all have to agree. The newest
    decides alone: where it is switched off or its rollout leaves the install out, no older one takes its place. An install
    with a beta_cohort has the bucket of its cohort instead of its own.
    """
    keys = [c for c in ("channel", "platform", "arch", "install_source") if c in installs.columns and c in releases.columns]
    offers = releases.withColumn("key", version_key(F.col("version"))).withColumn("least", version_key(F.col("minimum_version"))).filter("key IS NOT NULL").withColumnRenamed("version", "offer")
    rows = installs.withColumn("own", version_key(F.col("version"))).join(few(cut(offers)), keys).filter(F.col("key") > F.col("own"))
    must = F.col("mandatory") | F.coalesce(F.col("own") < F.col("least"), F.lit(False))
    bucket = F.coalesce(cohort_bucket(F.col("beta_cohort")), F.col("bucket")) if "beta_cohort" in installs.columns else F.col("bucket")
    verdict = F.when(F.col("kill_switch"), "switched off").when(must | (bucket < F.least("rollout", F.lit(100))), "available").otherwise("held back")
    return rows.groupBy("install").agg(F.max_by(F.struct("offer", must.alias("must"), verdict.alias("verdict")), "key").alias("x")).select("install", "x.*")


def histogram(rows: DataFrame, seconds: Column, keys: list[str]) -> DataFrame:
    """Cumulative counts at each edge, in one pass over the rows."""
    cells = [F.count_if(seconds <= e).alias(f"c{i}") for i, e in enumerate(EDGES)]
    per = rows.groupBy(*keys).agg(*cells, F.count("*").alias("total"))
    long = F.array(*[F.struct(F.lit(str(e)).alias("le"), F.col(f"c{i}").alias("n")) for i, e in enumerate(EDGES)], F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return per.select(*keys, F.explode(long).alias("x")).select(*keys, "x.le", "x.n")


def labelled(value: Column, bounds: list[tuple[int, str]], rest: str) -> Column:
    """The label of the first bound that the value is below."""
    out = F.when(value < bounds[0][0], bounds[0][1])
    for bound, label in bounds[1:]:
        out = out.when(value < bound, label)
    return out.otherwise(rest)


SIZES = [(1_000_000, "<1MB"), (10 << 20, "1-10MB"), (100 << 20, "10-100MB"), (1 << 30, "100MB-1GB")]
LATENCIES = [(100, "<100ms"), (500, "100-500ms"), (2000, "500ms-2s"), (10000, "2-10s")]


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_nth") <= n).drop("_nth")


def durability(facts: DataFrame) -> Column:
    """The rules in their order: what cannot be known comes first, then custody, then what is at risk."""
    return (
        F.when(F.col("unknown"), "Unknown").when(F.col("custody"), "Protected").when(~F.col("swept"), "Unknown").when(~F.col("other_replica"), "AtRisk").when(F.col("unobtainable"), "AtRisk").when(F.col("local_full") & F.col("partial"), "Protecting").otherwise("Unknown")
    )


def pack(items: DataFrame, keys: list[str], order: str, cost: str, most_items: int = 64, most_cost: int = 256 << 20, epochs: str | None = None, most_epochs: int = 128, unit: str | None = None) -> DataFrame:
    """items with slice: consecutive units of a plan, in order, until a slice would pass a bound; a larger unit stands alone.

    unit names the column whose equal values stay together (none: each item is a unit); units go by their first item.
    epochs names the column with the epochs that an item takes (none: one each).

    Where a slice that begins at a unit ends follows from running sums: it is the last unit whose sum stays within the bound
    above the sum before the first. So every unit has a pointer to the begin of the next slice. A plan's slices are the
    units that the first one's pointers lead to; these are collected by doubling: the first 2^k slice begins and pointers
    over 2^k slices give 2^(k+1) of each. A plan of any length takes log2(slices) joins and no fold.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    own = items.withColumns({n: F.col(k) for n, k in zip(names, keys)} | {"_unit": F.col(unit or order)})
    sums = {"_count": F.count("*"), "_cost": F.sum(cost), "_epochs": F.sum(epochs) if epochs else F.count("*")}
    units = own.groupBy(*names, "_unit").agg(F.min(order).alias("_order"), *[x.alias(n) for n, x in sums.items()])
    along = Window.partitionBy(*names).orderBy("_order", "_unit")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    placed = cut(units.withColumns({"_at": F.row_number().over(along).cast("long")} | {f"_sum{n}": F.sum(n).over(upto) for n in sums}))
    last = placed.select(*names, "_at")
    for n, most in zip(sums, (most_items, most_cost, most_epochs)):
        there = placed.select(*names, F.col(f"_sum{n}").alias("_v"), F.col("_at").alias("_there"), F.lit(None).cast("long").alias("_at"))
        asked = placed.select(*names, (F.col(f"_sum{n}") - F.col(n) + F.lit(most)).alias("_v"), F.lit(None).cast("long").alias("_there"), "_at")
        by_sum = Window.partitionBy(*names).orderBy("_v", F.col("_there").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
        found = there.unionByName(asked).withColumn("_last", F.max("_there").over(by_sum)).filter("_at IS NOT NULL").select(*names, "_at", F.coalesce("_last", F.lit(0)).alias(f"_last{n}"))
        last = last.join(found, [*names, "_at"])
    ahead = last.select(*names, "_at", (F.greatest(F.least(*[f"_last{n}" for n in sums]), F.col("_at")) + 1).alias("_next"))
    ends = placed.groupBy(*names).agg(F.max("_at").alias("_end"))
    ahead = cut(ahead.join(ends, names).filter("_next <= _end").select(*names, "_at", "_next"))
    begins = placed.filter("_at = 1").select(*names, "_at")
    while not ahead.isEmpty():
        begins = cut(begins.unionByName(begins.join(ahead, [*names, "_at"]).select(*names, F.col("_next").alias("_at"))))
        ahead = cut(ahead.join(ahead.select(*names, F.col("_at").alias("_next"), F.col("_next").alias("_far")), [*names, "_next"]).select(*names, "_at", F.col("_far").alias("_next")))
    numbered = placed.select(*names, "_unit", "_at").join(begins.withColumn("_begin", F.lit(1)), [*names, "_at"], "left")
    numbered = numbered.select(*names, "_unit", (F.count("_begin").over(Window.partitionBy(*names).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("slice"))
    return own.join(numbered, [*names, "_unit"]).select(*items.columns, "slice")


def content_chunks(blobs: DataFrame, smallest: int, average: int, largest: int) -> DataFrame:
    """(doc_id, ord, hash, size): chunks that end where a rolling hash of the last 48 bytes hits a mask.

    An insertion moves only the boundaries near it, so what follows keeps its hashes.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa

    mask = (1 << max(average - smallest, 2).bit_length() - 1) - 1
    table = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)

    def ends(data: np.ndarray) -> list[int]:
        h = np.zeros(len(data), dtype=np.uint64)
        for k in range(min(48, len(data))):
            h[k:] += table[data[: len(data) - k]] << np.uint64(k)
        hits = np.flatnonzero((h >> np.uint64(40)) & np.uint64(mask) == 0) + 1
        out, begin = [], 0
        while begin < len(data):
            at = np.searchsorted(hits, begin + smallest)
            end = min(int(hits[at]) if at < len(hits) else len(data), begin + largest, len(data))
            out.append(end)
            begin = end
        return out

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            rows: list[tuple] = []
            for name, raw in zip(b.column("doc_id").to_pylist(), b.column("data").to_pylist()):
                begin = 0
                for n, end in enumerate(ends(np.frombuffer(raw or b"", dtype=np.uint8))):
                    rows.append((name, n, hashlib.sha256(raw[begin:end]).hexdigest(), end - begin))
                    begin = end
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "ord", "hash", "size"])

    return blobs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("data")).mapInArrow(batches, "doc_id long, ord long, hash string, size long")


# Recovery of operations: local state, remote status -> recommendation. Fixed tables; NC marks what needs comparable identity.

ENROLL_REMOTE = ["not found", "unavailable", "preparing", "prepared", "active", "cancelled"]
ENROLLMENT = {
    "PreparePending": ("NOT has_link AND NOT has_marker", ["retry same", "wait evidence", "wait auto", "wait auto", "conflict", "conflict"]),
    "Prepared both": ("has_link AND has_marker", ["wait auto", "wait auto", "wait auto", "wait auto", "conflict", "wait auto"]),
    "Prepared none": ("NOT has_link AND NOT has_marker", ["CREATE manual retry same", "wait evidence", "wait auto", "wait auto", "conflict", "NC settle"]),
    "LocalSetupPending": ("has_link = has_marker", ["wait auto", "wait auto", "wait auto", "wait auto", "conflict", "wait auto"]),
    "ActivationPending both": ("has_link AND has_marker", ["wait auto", "wait evidence", "wait auto", "NC retry activation", "NC settle", "wait auto"]),
    "ActivationPending link": ("has_link AND NOT has_marker", ["manual", "manual", "manual", "manual", "NC settle", "manual"]),
    "ActivationPending none": ("NOT has_link AND NOT has_marker", ["NC settle", "wait evidence", "retry cancel", "retry cancel", "conflict", "NC settle"]),
    "ActivationPending other": ("NOT has_link AND has_marker", ["wait auto", "wait evidence", "wait auto", "wait auto", "conflict", "wait auto"]),
    "CancelPending": ("NOT has_link AND NOT has_marker", ["retry cancel", "wait evidence", "retry cancel", "retry cancel", "conflict", "NC settle"]),
}
MEMBER_REMOTE = ["not found", "unavailable", "committed", "rejected"]
MEMBERSHIP = {
    "Prepared": ("TRUE", ["retry same", "wait evidence", "settle", "settle"]),
    "Ambiguous": ("TRUE", ["retry same", "wait evidence", "settle", "settle"]),
    "LocalSettlementPending known": ("scope_known", ["settle", "settle", "settle", "conflict"]),
    "LocalSettlementPending unknown": ("NOT scope_known", ["wait evidence", "wait evidence", "AFFECTED settle manual", "conflict"]),
    "Completed": ("TRUE", ["settle", "settle", "settle", "conflict"]),
    "DefinitelyRejected": ("TRUE", ["settle", "settle", "conflict", "settle"]),
}


def decisions() -> list[tuple[str, str, str, str, str]]:
    """The tables as rows (domain, state, shape condition, remote, outcome)."""
    rows = [("enrollment", k.split()[0], shape, r, o) for k, (shape, outs) in ENROLLMENT.items() for r, o in zip(ENROLL_REMOTE, outs)]
    return rows + [("membership", k.split()[0], shape, r, o) for k, (shape, outs) in MEMBERSHIP.items() for r, o in zip(MEMBER_REMOTE, outs)]


def decision_sql() -> str:
    """The decision as one SQL expression, the same in both engines."""
    done = {"NC settle": "CASE WHEN comparable THEN 'settle' ELSE 'manual' END", "NC retry activation": "CASE WHEN comparable THEN 'retry activation' ELSE 'manual' END", "CREATE manual retry same": "CASE WHEN joins THEN 'retry same' ELSE 'manual' END", "AFFECTED settle manual": "CASE WHEN affected_groups THEN 'settle' ELSE 'manual' END"}
    cases = ["WHEN domain IS NULL THEN 'manual'", "WHEN domain = 'role_loss' AND state IN ('Prepared', 'WorkerCommitted', 'Compensating') THEN 'continue compensation'", "WHEN domain = 'role_loss' THEN 'settle'", "WHEN status IS NULL THEN 'wait evidence'"]
    cases += ["WHEN domain = 'enrollment' AND state = 'CancelPending' AND has_link AND NOT has_marker THEN 'conflict'"]
    cases += [f"WHEN domain = '{d}' AND state = '{s}' AND status = '{r}' AND ({shape}) THEN {done.get(o) or repr(o)}" for d, s, shape, r, o in decisions()]
    return "CASE " + " ".join(cases) + " ELSE 'manual' END"


def reconcile(journal: DataFrame, remote: DataFrame) -> DataFrame:
    """What to do about every operation that either side knows, and whether that is safe without a person."""
    rows = journal.join(remote, "operation_id", "full_outer").withColumn("recommendation", F.expr(decision_sql()))
    return rows.select("operation_id", "domain", "recommendation", F.col("recommendation").isin("settle", "retry same", "retry activation", "retry cancel", "wait auto", "continue compensation").alias("auto_safe"))
