"""Queries over file indexes and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import files as X
from driftwell.operators import merkle as M
from driftwell.plans.catalog import Views, query
from driftwell.plans.lineage import cut
from driftwell.plans.lineage import new_folder
from driftwell.sources import sinks as K

NOW = 1709251200000000
LIVE = "state = 'current' AND NOT deleted"


@query("src3_current_files", "SELECT group_id, path, size, version_hash FROM fx_files WHERE state = 'current'")
def src3(v):
    return v.fx_files.filter("state = 'current'").select("group_id", "path", "size", "version_hash")


@query("src4_paths_lookup", "SELECT group_id, path, version_seq FROM fx_files WHERE state = 'current' AND (group_id, path) IN (SELECT DISTINCT group_id, path FROM fx_intents)")
def src4(v):
    return v.fx_files.filter("state = 'current'").join(v.fx_intents, X.PATH, "left_semi").select("group_id", "path", "version_seq")


@query("win3_version_history", "SELECT group_id, path, version_seq, state, size FROM fx_files")
def win3(v):
    return X.build_history(v.fx_writes).select("group_id", "path", "version_seq", "state", "size")


@query("win4_version_listing", "SELECT group_id, path, version_seq, row_number() OVER (PARTITION BY group_id, path ORDER BY version_seq DESC) AS nth FROM fx_files")
def win4(v):
    return X.newest_first(v.fx_files).select("group_id", "path", "version_seq", "nth")


LEASES = "SELECT group_id, path, version_seq, CASE WHEN version_seq % 2 = 0 THEN 'confirmed' ELSE 'released' END AS state, 1709251200 + version_seq - 3 AS expires_at FROM fx_files WHERE version_seq % 3 = 1 OR version_seq = 4"


@query("win1_retention_expiry", f"""WITH l AS ({LEASES}), r AS (SELECT *, row_number() OVER (PARTITION BY group_id, path ORDER BY version_seq DESC) AS nth FROM fx_files)
SELECT group_id, path, version_seq FROM r WHERE nth > 2 AND us < {NOW} - 30 * 86400000000 AND NOT EXISTS (SELECT 1 FROM l WHERE l.group_id = r.group_id AND l.path = r.path AND l.version_seq = r.version_seq AND l.state IN ('provisional', 'confirmed') AND l.expires_at > 1709251200)""")
def win1(v):
    f = v.fx_files
    leases = f.filter("version_seq % 3 = 1 OR version_seq = 4").select(*X.PATH, "version_seq", F.when(F.col("version_seq") % 2 == 0, "confirmed").otherwise("released").alias("state"), (F.col("version_seq") + 1709251197).alias("expires_at"))
    return X.expired(f, leases, NOW, keep=2).select("group_id", "path", "version_seq")


@query("jn2_trash_listing", "SELECT t.group_id, t.path, max(t.version_seq) AS version_seq, c.us AS deleted_at FROM fx_files t JOIN fx_files c ON c.group_id = t.group_id AND c.path = t.path AND c.state = 'current' AND c.deleted WHERE t.state = 'trashed' GROUP BY t.group_id, t.path, c.us")
def jn2(v):
    return X.trash(v.fx_files)


@query("ag2_materialization_counts", f"SELECT group_id, count(*) FILTER (materialization_state = 'hydrated') AS hydrated, count(*) FILTER (materialization_state = 'placeholder') AS placeholder, count(*) FILTER (materialization_state IN ('hydrating', 'evicting')) AS hydrating FROM fx_files WHERE {LIVE} GROUP BY group_id")
def ag2(v):
    is_ = lambda *x: F.count_if(F.col("materialization_state").isin(*x))
    return v.fx_files.filter(LIVE).groupBy("group_id").agg(is_("hydrated").alias("hydrated"), is_("placeholder").alias("placeholder"), is_("hydrating", "evicting").alias("hydrating"))


@query("ag3_hydrated_usage", f"SELECT group_id, CAST(sum(size) AS BIGINT) AS bytes FROM fx_files WHERE {LIVE} AND materialization_state = 'hydrated' GROUP BY group_id")
def ag3(v):
    return v.fx_files.filter(f"{LIVE} AND materialization_state = 'hydrated'").groupBy("group_id").agg(F.sum("size").alias("bytes"))


@query("flt10_evictable_files", f"SELECT group_id, path, size FROM fx_files WHERE {LIVE} AND NOT pinned AND materialization_state = 'hydrated'")
def flt10(v):
    return v.fx_files.filter(f"{LIVE} AND NOT pinned AND materialization_state = 'hydrated'").select("group_id", "path", "size")


@query("flt14_stale_in_flight", "SELECT group_id, path, CASE WHEN materialization_state IN ('hydrating', 'evicting') THEN 'placeholder' ELSE materialization_state END AS materialization_state FROM fx_files WHERE state = 'current'")
def flt14(v):
    reset = F.when(F.col("materialization_state").isin("hydrating", "evicting"), "placeholder").otherwise(F.col("materialization_state"))
    return v.fx_files.filter("state = 'current'").select("group_id", "path", reset.alias("materialization_state"))


@query("win5_lru_eviction", f"""WITH live AS (SELECT * FROM fx_files WHERE {LIVE} AND materialization_state = 'hydrated'), u AS (SELECT group_id, sum(size) AS usage FROM live GROUP BY group_id),
caps AS (SELECT group_id, cap FROM fx_links WHERE NOT orphaned AND policy = 'on_demand'),
q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY group_id ORDER BY last_accessed NULLS FIRST, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM live WHERE NOT pinned)
SELECT q.group_id, path, size FROM q JOIN u USING (group_id) JOIN caps USING (group_id) WHERE usage - before > cap""")
def win5(v):
    caps = v.fx_links.filter("NOT orphaned AND policy = 'on_demand'").select("group_id", "cap")
    return X.evict(v.fx_files, caps).select("group_id", "path", "size")


@query("jn14_repair_candidates", f"SELECT f.group_id, f.path, l.link_id FROM fx_files f JOIN fx_links l USING (group_id) WHERE {LIVE} AND NOT orphaned AND (materialization_state = 'hydrating' OR (materialization_state = 'placeholder' AND (policy = 'eager' OR pinned)))")
def jn14(v):
    return v.fx_files.filter(LIVE).join(v.fx_links.filter("NOT orphaned"), "group_id").filter("materialization_state = 'hydrating' OR (materialization_state = 'placeholder' AND (policy = 'eager' OR pinned))").select("group_id", "path", "link_id")


@query("flt11_identity_reconcile", "WITH i AS (SELECT *, sha256(concat_ws(':', path, CAST(size AS VARCHAR))) AS own, CASE WHEN event_id % 37 = 0 THEN 'stale' ELSE sha256(concat_ws(':', path, CAST(size AS VARCHAR))) END AS stored FROM fx_files) SELECT group_id, path, version_seq, own FROM i WHERE stored <> own")
def flt11(v):
    own = F.sha2(F.concat_ws(":", "path", F.col("size").cast("string")), 256)
    rows = v.fx_files.withColumn("own", own).withColumn("stored", F.when(F.col("event_id") % 37 == 0, "stale").otherwise(F.col("own")))
    return rows.filter("stored <> own").select("group_id", "path", "version_seq", "own")


#: Item hashes in order, digested by their first two digits, and the parts' digests digested again.
DIGEST = "sha256(array_to_string(list_transform(list_sort(list_distinct(list(substring(sha256({0}), 1, 2)))), lambda p: sha256(array_to_string(list_filter(list_sort(list_distinct(list(sha256({0})))), lambda h: substring(h, 1, 2) = p), ','))), ','))"


def tree_sql(items: str, leaf: int, depths: int = 8) -> str:
    """CTEs up to d0(group_id, p, digest), the Merkle roots of items(group_id, h), depth by depth from the definition."""
    out = [f"items AS (SELECT DISTINCT group_id, sha256(x) AS h FROM ({items}))"]
    out += [f"n{d} AS (SELECT group_id, substring(h, 1, {d}) AS p, count(*) AS n FROM items GROUP BY ALL)" for d in range(depths + 1)]
    for d in range(depths, -1, -1):
        leaves = f"SELECT i.group_id, n{d}.p, sha256('leaf:' || string_agg(h, ',' ORDER BY h)) AS digest FROM items i JOIN n{d} ON n{d}.group_id = i.group_id AND n{d}.p = substring(h, 1, {d}) WHERE n <= {leaf} GROUP BY ALL"
        inner = f" UNION ALL SELECT c.group_id, substring(c.p, 1, {d}) AS p, sha256('node:' || string_agg(substring(c.p, {d + 1}, 1) || digest, ',' ORDER BY c.p)) FROM d{d + 1} c JOIN n{d} ON n{d}.group_id = c.group_id AND n{d}.p = substring(c.p, 1, {d}) WHERE n > {leaf} GROUP BY ALL" if d < depths else ""
        out.append(f"d{d} AS ({leaves}{inner})")
    return ",\n".join(out)


@query("dig1_durability_roots", f"WITH {tree_sql(f'SELECT group_id, path || chr(58) || version_hash AS x FROM fx_files WHERE {LIVE}', M.LEAF, 3)} SELECT group_id, digest FROM d0")
def dig1(v):
    return M.roots(M.tree(M.hashed(v.fx_files.filter(LIVE), ["group_id"], "path", "version_hash"), ["group_id"]), ["group_id"])


@query("dig1_incremental_roots", f"WITH {tree_sql(f'SELECT group_id, path || chr(58) || version_hash AS x FROM fx_files WHERE {LIVE}', 4)} SELECT group_id, digest FROM d0")
def dig1_incremental(v):
    """With leaves of four: a tree over nine tenths of the files, to which the rest are added."""
    live = v.fx_files.filter(LIVE)
    first = cut(M.hashed(live.filter("event_id % 10 <> 3"), ["group_id"], "path", "version_hash"))
    rest = M.hashed(live.filter("event_id % 10 = 3"), ["group_id"], "path", "version_hash")
    return M.roots(M.added(M.tree(first, ["group_id"], 4), first, rest, ["group_id"], 4)[0], ["group_id"])


FRONTIERS = """e AS (SELECT group_id, path, list(DISTINCT change_hash) AS heads FROM fx_touches GROUP BY group_id, path UNION ALL SELECT group_id, min(path), ['other'] FROM fx_touches WHERE group_id % 11 = 0 GROUP BY group_id),
twice AS (SELECT group_id, min(path) AS twice FROM (SELECT group_id, path FROM e GROUP BY group_id, path HAVING count(*) > 1) GROUP BY group_id)"""


@query("dig2_frontier_digest", f"WITH {FRONTIERS}, {tree_sql('SELECT group_id, path || chr(58) || CAST(len(heads) AS VARCHAR) || chr(58) || array_to_string(list_sort(heads), chr(44)) AS x FROM e', M.LEAF, 3)} SELECT group_id, CASE WHEN twice IS NULL THEN digest END AS digest, twice AS error FROM d0 LEFT JOIN twice USING (group_id)")
def dig2(v):
    """Over every path with the changes that touch it; groups with two entries for a path get an error and no digest."""
    once = v.fx_touches.groupBy("group_id", "path").agg(F.collect_set("change_hash").alias("heads"))
    again = v.fx_touches.filter("group_id % 11 = 0").groupBy("group_id").agg(F.min("path").alias("path")).withColumn("heads", F.array(F.lit("other")))
    items, errors = M.frontier_items(once.unionByName(again), ["group_id"])
    found = M.roots(M.tree(items, ["group_id"]), ["group_id"])
    return found.join(errors, "group_id", "left").select("group_id", F.when(F.col("twice").isNull(), F.col("digest")).alias("digest"), F.col("twice").alias("error"))


@query("dig2_causal_basis", """WITH s AS (SELECT group_id, child_hash, list_sort(list_distinct(list(parent_hash))) AS m FROM fx_edges GROUP BY group_id, child_hash),
named AS (SELECT CAST(s.group_id AS VARCHAR) || ':' || sha256(CAST(s.group_id AS VARCHAR) || ':' || CAST(len(m) AS VARCHAR) || ':' || array_to_string(m, ',')) AS basis_id, s.group_id, len(m) AS n_members, event_id % 2 AS batch FROM s JOIN fx_changes c ON c.change_hash = s.child_hash)
SELECT basis_id, group_id, CAST(n_members AS INTEGER) AS n_members, CAST(min(batch) AS BIGINT) AS batch FROM named GROUP BY ALL""")
def dig2_basis(v):
    """The parent sets of changes, interned in two batches; a set that the first one has keeps its batch."""
    sets = v.fx_edges.groupBy("group_id", F.col("child_hash").alias("change_hash")).agg(F.collect_set("parent_hash").alias("members")).join(v.fx_changes.select("change_hash", "event_id"), "change_hash")
    first = M.interned(None, sets.filter("event_id % 2 = 0"), 0)
    return M.interned(cut(first), sets.filter("event_id % 2 = 1"), 1).select("basis_id", "group_id", F.size("members").alias("n_members"), "batch")


@query("jn19_plan_staleness", f"SELECT group_id, digest <> CASE WHEN group_id % 9 = 0 THEN 'old' ELSE digest END OR group_id % 7 < group_id % 4 AS stale FROM (SELECT group_id, {DIGEST.format('change_hash')} AS digest FROM fx_frontier GROUP BY group_id)")
def jn19(v):
    now = X.set_digest(v.fx_frontier, ["group_id"], ["change_hash"])
    plans = now.select("group_id", F.when(F.col("group_id") % 9 == 0, "old").otherwise(F.col("digest")).alias("planned"), (F.col("group_id") % 7).alias("generation"))
    return now.join(plans, "group_id").select("group_id", ((F.col("digest") != F.col("planned")) | (F.col("generation") < F.col("group_id") % 4)).alias("stale"))


@query("ag22_ambiguous_groups", "SELECT group_id, count(*) AS n, array_to_string(list_sort(list(local_path)), ',') AS paths FROM fx_links WHERE NOT orphaned GROUP BY group_id HAVING count(*) > 1")
def ag22(v):
    return v.fx_links.filter("NOT orphaned").groupBy("group_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("local_path")), ",").alias("paths")).filter("n > 1")


@query("ag23_materialization_coverage", "SELECT f.group_id, count(*) FILTER (deleted) AS tombstones, count(*) FILTER (NOT deleted AND (materialization_state <> 'hydrated' OR i.path IS NOT NULL)) AS unconfirmed, count(*) FILTER (NOT deleted AND event_id % 100 = 3) AS without_author, count(*) AS total FROM fx_files f LEFT JOIN fx_intents i USING (group_id, path) WHERE state = 'current' GROUP BY f.group_id")
def ag23(v):
    rows = v.fx_files.filter("state = 'current'").join(v.fx_intents.withColumn("open", F.lit(True)), X.PATH, "left")
    live = ~F.col("deleted")
    return rows.groupBy("group_id").agg(F.count_if("deleted").alias("tombstones"), F.count_if(live & ((F.col("materialization_state") != "hydrated") | F.col("open").isNotNull())).alias("unconfirmed"), F.count_if(live & (F.col("event_id") % 100 == 3)).alias("without_author"), F.count("*").alias("total"))


@query("jn21_history_gap", "SELECT DISTINCT group_id, path, CASE WHEN deleted THEN 'delete' ELSE 'put' END AS op FROM fx_files WHERE state = 'current' AND (group_id, path) NOT IN (SELECT DISTINCT group_id, path FROM fx_touches WHERE event_id % 41 <> 0)")
def jn21(v):
    told = v.fx_touches.filter("event_id % 41 <> 0").select(*X.PATH)
    return v.fx_files.filter("state = 'current'").join(told, X.PATH, "left_anti").select(*X.PATH, F.when(F.col("deleted"), "delete").otherwise("put").alias("op"))


@query("jn23_author_audit", "SELECT group_id, path, version_seq FROM fx_files WHERE state = 'current' AND (event_id % 100 = 3 OR change_hash NOT IN (SELECT change_hash FROM fx_received UNION SELECT child_hash FROM fx_pruned_edges))")
def jn23(v):
    known = v.fx_received.select("change_hash").union(v.fx_pruned_edges.select("child_hash"))
    rows = v.fx_files.filter("state = 'current'").withColumn("author", F.when(F.col("event_id") % 100 != 3, F.col("change_hash")))
    return rows.join(known.withColumnRenamed("change_hash", "author"), "author", "left_anti").select("group_id", "path", "version_seq")


@query("jn22_orphan_roots", f"SELECT owner, CASE WHEN obligation_live THEN 'held' WHEN registered_at <= 0 THEN 'unknown age' WHEN registered_at > {NOW} - 40 * 86400000000 THEN 'in grace' ELSE 'released' END AS outcome, count(*) AS n FROM fx_roots GROUP BY ALL")
def jn22(v):
    outcome = F.when(F.col("obligation_live"), "held").when(F.col("registered_at") <= 0, "unknown age").when(F.col("registered_at") > NOW - 40 * 86400000000, "in grace").otherwise("released")
    return v.fx_roots.groupBy("owner", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("jn13_unobtainable_content", f"""WITH c AS (SELECT f.group_id, f.path, f.version_hash, f.device_id FROM fx_files f WHERE {LIVE} AND (f.group_id, f.device_id) NOT IN (SELECT group_id, device_id FROM fx_writers))
SELECT group_id, path FROM c WHERE NOT EXISTS (SELECT 1 FROM fx_writers w WHERE w.group_id = c.group_id AND w.device_id <> c.device_id AND NOT EXISTS (SELECT 1 FROM fx_refusals r WHERE r.group_id = c.group_id AND r.path = c.path AND r.version_hash = c.version_hash AND r.peer = w.device_id))""")
def jn13(v):
    lost = v.fx_files.filter(LIVE).join(v.fx_writers, ["group_id", "device_id"], "left_anti").select("group_id", "path", "version_hash", F.col("device_id").alias("origin"))
    others = lost.join(v.fx_writers, "group_id").filter("device_id <> origin").withColumnRenamed("device_id", "peer")
    willing = others.join(v.fx_refusals, ["group_id", "path", "version_hash", "peer"], "left_anti")
    return lost.join(willing, X.PATH, "left_anti").select(*X.PATH)


@query("jn1_disk_vs_index", """WITH i AS (SELECT * FROM fx_files WHERE state = 'current' AND NOT deleted), j AS (SELECT coalesce(i.group_id, d.group_id) AS group_id, coalesce(i.path, d.path) AS path, i.size AS isz, d.size AS dsz, i.us AS ius, d.us AS dus, i.version_hash AS ih, d.hash AS dh FROM i FULL JOIN fx_inventory d ON d.group_id = i.group_id AND d.path = i.path)
SELECT j.group_id, j.path, CASE WHEN dsz IS NULL THEN CASE WHEN (j.group_id % 5 = 0 AND split_part(j.path, '/', 1) = 'dir1') OR t.path IS NOT NULL THEN 'kept' ELSE 'tombstone' END WHEN j.path LIKE '%.tmp' THEN 'ignored' WHEN isz IS NULL THEN 'added' WHEN dsz <> isz THEN 'modified' WHEN dus = ius THEN 'unchanged' WHEN dh = ih THEN 'unchanged' ELSE 'modified' END AS status
FROM j LEFT JOIN fx_intents t ON t.group_id = j.group_id AND t.path = j.path""")
def jn1(v):
    index = v.fx_files.filter(LIVE)
    ignored = v.fx_inventory.filter("path LIKE '%.tmp'").select(*X.PATH).distinct()
    failed = index.filter("group_id % 5 = 0").select("group_id", F.lit("dir1").alias("top")).distinct()
    return X.compare_with_disk(index, v.fx_inventory, ignored, failed, v.fx_intents)


@query("jn20_crash_triage", """WITH whole AS (SELECT group_id, version_hash, bool_and(s.hash IS NOT NULL) AS whole FROM (SELECT DISTINCT group_id, version_hash FROM fx_files) f JOIN fx_version_blocks b USING (version_hash) LEFT JOIN fx_stored s USING (group_id, hash) GROUP BY ALL)
SELECT f.group_id, f.path, CASE WHEN d.size = f.size AND d.hash = f.version_hash THEN 'ok' WHEN d.size IS NULL AND i.path IS NULL THEN 'offline delete' WHEN w.whole THEN 'reconstruct' ELSE 'demote' END AS outcome,
  d.size IS NOT NULL AND NOT coalesce(d.size = f.size AND d.hash = f.version_hash, false) AS quarantine
FROM fx_files f LEFT JOIN whole w ON w.group_id = f.group_id AND w.version_hash = f.version_hash LEFT JOIN fx_inventory d ON d.group_id = f.group_id AND d.path = f.path LEFT JOIN fx_intents i ON i.group_id = f.group_id AND i.path = f.path WHERE state = 'current' AND NOT deleted AND materialization_state = 'hydrated'""")
def jn20(v):
    return X.triage(v.fx_files, v.fx_inventory, v.fx_intents, v.fx_version_blocks, v.fx_stored)


# Blocks. In tests of this size a block is 256 bytes; DuckDB cuts the hexadecimal form.

BLOCKS = """hx AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents WHERE octet_length(encode(text)) > 0),
o AS (SELECT doc_id, hex(b) AS h, n, unnest(generate_series(0, CAST(floor((n - 1) / 256) AS BIGINT))) AS ord FROM hx),
blocks AS (SELECT doc_id, ord, sha256(unhex(substring(h, ord * 512 + 1, 512))) AS hash, ord * 256 AS "offset", least(256, n - ord * 256) AS size FROM o)"""


def blocks(v: Views):
    return X.blocks_of(v.documents, 256)


@query("ag6_fixed_chunking", f"WITH {BLOCKS} SELECT doc_id, ord, hash, \"offset\", size FROM blocks")
def ag6(v):
    return blocks(v)


@query("src5_block_lists", f"WITH {BLOCKS} SELECT doc_id, ord, hash, \"offset\", size FROM blocks")
def src5(v):
    return X.expand_blocks(X.block_json(blocks(v)))[0]


@query("src5_quarantined_lists", f"WITH {BLOCKS}, n AS (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id) SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'no list of blocks' WHEN 1 THEN 'bad block' WHEN 2 THEN 'gap' END AS reason FROM n WHERE doc_id % 7 IN (0, 1) OR (doc_id % 7 = 2 AND n > 2)")
def src5_quarantine(v):
    """Lists that were cut off, that lost a size, or whose second block is gone."""
    kind = F.col("doc_id") % 7
    size = F.when((kind != 1) | (F.col("ord") > 0), F.col("size"))
    lists = X.block_json(blocks(v).filter("doc_id % 7 <> 2 OR ord <> 1").withColumn("size", size))
    cut_off = F.when(kind == 0, F.expr("substring(blocks_json, 1, length(blocks_json) - 3)")).otherwise(F.col("blocks_json"))
    return X.expand_blocks(lists.withColumn("blocks_json", cut_off))[1]


@query("ag4_live_blocks", f"WITH {BLOCKS} SELECT DISTINCT hash FROM blocks WHERE doc_id % 3 <> 0 UNION SELECT DISTINCT hash FROM blocks WHERE doc_id % 21 = 0")
def ag4(v):
    b = blocks(v)
    return b.filter("doc_id % 3 <> 0").select("hash").union(b.filter("doc_id % 21 = 0").select("hash")).distinct()


@query("ag5_dedup_account", f"WITH {BLOCKS} SELECT CAST(sum(refs) AS BIGINT) AS n_refs, count(*) AS n_blocks, CAST(sum(refs * size) AS BIGINT) AS logical_bytes, CAST(sum(size) AS BIGINT) AS unique_bytes FROM (SELECT hash, count(*) AS refs, max(size) AS size FROM blocks GROUP BY hash)")
def ag5(v):
    return X.dedup_account(blocks(v))


#: When the sweep began, and when a block of a document was written: spread over the half hour before and a little after.
SWEPT_AT = 1706745600000000
WRITTEN = "1706743800000000 + (doc_id * 7919 + ord * 104729) % 1860 * 1000000"


@query("jn5_block_sweep", f"""WITH {BLOCKS}, store AS (SELECT hash, min(size) AS size, max({WRITTEN}) AS us FROM blocks GROUP BY hash), live AS (SELECT hash FROM blocks WHERE doc_id % 3 <> 0),
m AS (SELECT size, CASE WHEN hash IN (SELECT hash FROM live) THEN 'live' WHEN us > {SWEPT_AT} - 600000000 THEN 'young' ELSE 'swept' END AS verdict FROM store) SELECT verdict, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM m GROUP BY verdict""")
def jn5(v):
    """What a sweep would delete, and what it keeps: blocks of files that are there, and those written within ten minutes before it."""
    b = blocks(v)
    store = b.groupBy("hash").agg(F.min("size").alias("size"), F.max(F.expr(WRITTEN)).alias("us"))
    return X.sweep(store, b.filter("doc_id % 3 <> 0"), SWEPT_AT).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("jn15_durable_holding", f"""WITH {BLOCKS}, f AS (SELECT doc_id AS file, CASE WHEN doc_id % 11 = 0 THEN 'on_demand' ELSE 'eager' END AS policy, CASE WHEN doc_id % 6 = 0 THEN 'hydrating' ELSE 'hydrated' END AS state, sha256(text) AS version FROM documents WHERE doc_id % 17 <> 0),
held AS (SELECT doc_id AS file, string_agg(hash || ':' || CAST(size AS VARCHAR), ',' ORDER BY ord) AS held, bool_and(hash IN (SELECT hash FROM blocks WHERE doc_id % 5 <> 0)) AS proven, bool_and(substring(hash, 1, 2) > '0a') AS fine FROM blocks WHERE doc_id % 17 <> 0 GROUP BY doc_id),
asked AS (SELECT d.doc_id AS file, CASE WHEN d.doc_id % 13 = 0 THEN 'other' ELSE sha256(text) END AS version, string_agg(hash || ':' || CAST(size + CASE WHEN d.doc_id % 7 = 2 THEN 1 ELSE 0 END AS VARCHAR), ',' ORDER BY CASE WHEN d.doc_id % 7 = 1 THEN -ord ELSE ord END) AS blocks FROM documents d LEFT JOIN blocks b ON b.doc_id = d.doc_id GROUP BY d.doc_id, text)
SELECT a.file, CASE WHEN policy IS NULL THEN 'unknown' WHEN policy <> 'eager' THEN 'not eager' WHEN a.version IS DISTINCT FROM f.version THEN 'other version' WHEN state <> 'hydrated' THEN 'not held' WHEN coalesce(held, '') <> coalesce(blocks, '') THEN 'other blocks'
  WHEN NOT coalesce(proven, true) THEN 'no provenance' WHEN NOT coalesce(fine, true) THEN 'damaged' ELSE 'durable' END AS verdict FROM asked a LEFT JOIN f ON f.file = a.file LEFT JOIN held h ON h.file = a.file""")
def jn15(v):
    """Every document asked for as a file: some with other versions, some with blocks turned round or of other sizes; some blocks without a provenance or damaged."""
    b = blocks(v).select(F.col("doc_id").alias("file"), "ord", "hash", F.col("size").cast("long").alias("size"))
    version = F.sha2(F.col("text").cast("binary"), 256)
    index = v.documents.filter("doc_id % 17 <> 0").select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 11 == 0, "on_demand").otherwise("eager").alias("policy"), F.when(F.col("doc_id") % 6 == 0, "hydrating").otherwise("hydrated").alias("state"), version.alias("version"))
    order = F.when(F.col("file") % 7 == 1, -F.col("ord")).otherwise(F.col("ord"))
    size = F.col("size") + F.when(F.col("file") % 7 == 2, 1).otherwise(0)
    lists = b.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "hash", size.alias("size")))), lambda x: F.struct(x["hash"].alias("hash"), x["size"].alias("size"))).alias("blocks"))
    asked = v.documents.select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 13 == 0, "other").otherwise(version).alias("version")).join(lists, "file", "left")
    asked = asked.withColumn("blocks", F.coalesce("blocks", F.array().cast("array<struct<hash:string,size:bigint>>")))
    store = b.select("hash").distinct().withColumn("digest", F.when(F.substring("hash", 1, 2) > "0a", F.col("hash")).otherwise("torn"))
    found = X.durable_holdings(asked, index, b.filter("file % 17 <> 0"), b.filter("file % 5 <> 0"), store)
    return found.select("file", "verdict")


@query("jn16_blocks_elsewhere", f"WITH {BLOCKS} SELECT doc_id, count(DISTINCT hash) AS n FROM blocks b WHERE EXISTS (SELECT 1 FROM blocks o WHERE o.hash = b.hash AND o.doc_id <> b.doc_id) GROUP BY doc_id")
def jn16(v):
    b = blocks(v)
    shared = b.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a <> z").select("hash")
    return b.join(shared, "hash", "left_semi").groupBy("doc_id").agg(F.countDistinct("hash").alias("n"))


@query("snk1_snapshot_digest", f"WITH d AS (SELECT group_id, {DIGEST.format('path || chr(58) || version_hash')} AS files FROM fx_files WHERE {LIVE} GROUP BY group_id), f AS (SELECT group_id, {DIGEST.format('change_hash')} AS frontier FROM fx_frontier GROUP BY group_id) SELECT group_id, sha256(coalesce(files, '-') || ':' || coalesce(frontier, '-')) AS snapshot FROM d FULL JOIN f USING (group_id)")
def snk1(v):
    """The snapshot is written, part by part; its digest is that of what was written."""
    live = v.fx_files.filter(LIVE).select("group_id", "path", "size", "version_hash")
    versions = v.fx_versions.join(live.select("version_hash").distinct(), "version_hash", "left_semi")
    parts = {"files": live, "frontier": v.fx_frontier.select("group_id", "device_id", "change_hash"), "versions": versions, "edges": v.fx_pruned_edges}
    written = K.write_snapshot(parts, new_folder(v.spark, "snapshot"))
    files = X.set_digest(written["files"], ["group_id"], ["path", "version_hash"], "files")
    frontier = X.set_digest(written["frontier"], ["group_id"], ["change_hash"], "frontier")
    return files.join(frontier, "group_id", "full_outer").select("group_id", F.sha2(F.concat_ws(":", F.coalesce("files", F.lit("-")), F.coalesce("frontier", F.lit("-"))), 256).alias("snapshot"))
