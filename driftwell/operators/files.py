"""Operators over file indexes: version history, retention, eviction, blocks, disk comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PATH = ["group_id", "path"]


#: Digits of an item's hash that choose its part of a digest: 16^DIGITS parts of a group.
DIGITS = 2


def build_history(writes: DataFrame) -> DataFrame:
    """Ordered writes as versions: numbered from 1; the last is current, one that a delete ended is trashed, others superseded."""
    order = Window.partitionBy(*PATH).orderBy("us", "event_id")
    ended = F.lead("deleted").over(order)
    state = F.when(ended.isNull(), "current").when(ended & ~F.col("deleted"), "trashed").otherwise("superseded")
    return writes.withColumn("version_seq", F.row_number().over(order).cast("long")).withColumn("state", state)


def newest_first(files: DataFrame) -> DataFrame:
    return files.withColumn("nth", F.row_number().over(Window.partitionBy(*PATH).orderBy(F.desc("version_seq"))).cast("long"))


def expired(files: DataFrame, leases: DataFrame, now_us: int, keep: int = 10, days: int = 30) -> DataFrame:
    """Versions beyond both bounds, by rank and by age, that no lease pins."""
    live = leases.filter(F.col("state").isin("provisional", "confirmed") & (F.col("expires_at") > now_us // 1_000_000))
    old = newest_first(files).filter((F.col("nth") > keep) & (F.col("us") < now_us - days * 86_400_000_000))
    return old.join(live.select(*PATH, "version_seq"), [*PATH, "version_seq"], "left_anti")


def trash(files: DataFrame) -> DataFrame:
    """The newest trashed version of each path whose current row is a tombstone."""
    gone = files.filter("state = 'current' AND deleted").select(*PATH, F.col("us").alias("deleted_at"))
    last = files.filter("state = 'trashed'").groupBy(*PATH).agg(F.max("version_seq").alias("version_seq"))
    return last.join(gone, PATH)


def evict(files: DataFrame, caps: DataFrame) -> DataFrame:
    """Files to evict, least recently used first, while a group's usage is over its cap. Pinned files count but stay."""
    live = files.filter("state = 'current' AND NOT deleted AND materialization_state = 'hydrated'")
    usage = live.groupBy("group_id").agg(F.sum("size").alias("usage"))
    order = Window.partitionBy("group_id").orderBy(F.col("last_accessed").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    queue = live.filter("NOT pinned").withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    return queue.join(usage, "group_id").join(caps, "group_id").filter("usage - before > cap")


def blocks_of(blobs: DataFrame, block_size: int | None = None) -> DataFrame:
    """(doc_id, ord, hash, offset, size): fixed blocks of each blob's bytes.

    Without a size: 128 KiB, doubled while there would be over 2000 blocks, at most 16 MiB.
    """
    data = F.col("text").cast("binary")
    size = F.octet_length("text")
    own = F.lit(block_size) if block_size else F.least(F.lit(1 << 24), F.lit(1 << 17) * F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(size / F.lit(2000 * (1 << 17))))))).cast("int")
    rows = blobs.filter(size > 0).select("doc_id", data.alias("data"), size.alias("n"), own.alias("bs"))
    rows = rows.withColumn("ord", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / F.col("bs")).cast("int"))))
    piece = F.expr("substring(data, ord * bs + 1, bs)")
    return rows.select("doc_id", F.col("ord").cast("long"), F.sha2(piece, 256).alias("hash"), (F.col("ord") * F.col("bs")).cast("long").alias("offset"), F.octet_length(piece).cast("long").alias("size"))


def block_json(blocks: DataFrame) -> DataFrame:
    """(doc_id, blocks_json): the block list as an index keeps it."""
    return blocks.groupBy("doc_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("ord", "hash", "offset", "size"))), lambda b: F.struct(b["hash"].alias("hash"), b["offset"].alias("offset"), b["size"].alias("size")))).alias("blocks_json"))


def expand_blocks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, quarantine): blocks_json as rows (doc_id, ord, hash, offset, size), and (doc_id, reason) of lists that can't be right.

    A list is quarantined as a whole: if it is no array of blocks, or if a block lacks its hash, its offset or a size above
    zero, or if the blocks, in order, do not follow each other from offset 0 on.
    """
    parsed = files.withColumn("b", F.from_json("blocks_json", "array<struct<hash:string,offset:long,size:long>>"))
    ends = F.transform("b", lambda x: x["offset"] + x["size"])
    starts = F.transform("b", lambda x: x["offset"])
    joined = F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, 1, F.greatest(F.size("b") - 1, F.lit(0))))
    whole = F.forall("b", lambda x: x["hash"].isNotNull() & x["offset"].isNotNull() & (x["size"] > 0))
    reason = F.when(F.col("blocks_json").isNull(), "no list").when(F.col("b").isNull(), "no list of blocks").when(~F.coalesce(whole, F.lit(False)), "bad block").when((F.size("b") > 0) & (starts != joined), "gap")
    judged = parsed.withColumn("reason", reason)
    rows = judged.filter("reason IS NULL").select("doc_id", F.posexplode("b").alias("ord", "b"))
    return rows.select("doc_id", F.col("ord").cast("long"), "b.hash", "b.offset", "b.size"), judged.filter("reason IS NOT NULL").select("doc_id", "reason")


def dedup_account(blocks: DataFrame) -> DataFrame:
    """One row: references, different blocks, logical and unique bytes."""
    per = blocks.groupBy("hash").agg(F.count("*").alias("refs"), F.max("size").alias("size"))
    return per.agg(F.sum("refs").alias("n_refs"), F.count("*").alias("n_blocks"), F.sum(F.col("refs") * F.col("size")).alias("logical_bytes"), F.sum("size").alias("unique_bytes"))


def compare_with_disk(index: DataFrame, disk: DataFrame, ignored: DataFrame, failed: DataFrame, intents: DataFrame) -> DataFrame:
    """Status of every path of an index and a disk inventory: size, then time, then content decides.

    A missing file is no tombstone below a failed prefix, under an open intent, or where ignored.
    """
    have = index.select(*PATH, F.col("size").alias("i_size"), F.col("us").alias("i_us"), F.col("version_hash").alias("i_hash"), F.lit(True).alias("i"))
    seen = disk.select(*PATH, F.col("size").alias("d_size"), F.col("us").alias("d_us"), F.col("hash").alias("d_hash"), F.lit(True).alias("d"))
    rows = have.join(seen, PATH, "full_outer").withColumn("top", F.substring_index("path", "/", 1))
    rows = rows.join(ignored.select(*PATH, F.lit(True).alias("skip")), PATH, "left").join(failed.select("group_id", "top", F.lit(True).alias("fail")), ["group_id", "top"], "left").join(intents.select(*PATH, F.lit(True).alias("open")), PATH, "left")
    missing = F.when(F.col("skip") | F.col("fail") | F.col("open"), "kept").otherwise("tombstone")
    changed = F.when(F.col("d_size") != F.col("i_size"), "modified").when(F.col("d_us") == F.col("i_us"), "unchanged").when(F.col("d_hash") == F.col("i_hash"), "unchanged").otherwise("modified")
    status = F.when(F.col("d").isNull(), missing).when(F.col("skip"), "ignored").when(F.col("i").isNull(), "added").otherwise(changed)
    return rows.select(*PATH, status.alias("status"))


def disk_inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(group_id, path, size, us, hash) of the files below a folder, by the reader's metadata; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.lit(0).cast("long").alias("group_id"), F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("us"), F.lit(None).cast("string").alias("hash"))


def table_index(table: DataFrame) -> DataFrame:
    """The files that a table's scan names, as an index."""
    m = F.col("_metadata")
    rows = table.select(F.element_at(F.split(m["file_path"], "/"), -1).alias("path"), m["file_size"].alias("size"), F.unix_micros(m["file_modification_time"]).alias("us")).distinct()
    return rows.select(F.lit(0).cast("long").alias("group_id"), "path", "size", "us", F.lit(None).cast("string").alias("version_hash"))


#: States of a file in which its bytes are its version's.
HELD_STATES = ("hydrated", "pinned")


def durable_holdings(requests: DataFrame, index: DataFrame, blocks: DataFrame, provenance: DataFrame, store: DataFrame) -> DataFrame:
    """requests(file, version, blocks) with verdict: durable, or the first rule that fails.

    blocks of a request: an array of (hash, size) in order. index(file, policy, state, version), blocks(file, ord, hash, size):
    what the index holds. provenance(hash): blocks that an authorized peer or writer gave. store(hash, digest): each block's
    digest as it is on disk now. The rules in order: the file is known, its folder is eager, its version is the one asked
    for, its state is a held one, its blocks are those asked for in order and size, each has a provenance, each verifies.
    """
    own = blocks.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "hash", "size"))), lambda b: F.struct(b["hash"].alias("hash"), b["size"].alias("size"))).alias("_held"))
    proven = provenance.select("hash").distinct().withColumn("_proven", F.lit(True))
    judged = blocks.select("file", "hash").join(proven, "hash", "left").join(store.select("hash", (F.col("digest") == F.col("hash")).alias("_fine")), "hash", "left")
    judged = judged.groupBy("file").agg(F.bool_and(F.coalesce("_proven", F.lit(False))).alias("_proven"), F.bool_and(F.coalesce("_fine", F.lit(False))).alias("_fine"))
    rows = requests.join(index.withColumnRenamed("version", "_version"), "file", "left").join(own, "file", "left").join(judged, "file", "left")
    none = F.array().cast("array<struct<hash:string,size:bigint>>")
    verdict = F.when(F.col("policy").isNull(), "unknown").when(F.col("policy") != "eager", "not eager").when(~F.col("version").eqNullSafe(F.col("_version")), "other version")
    verdict = verdict.when(~F.col("state").isin(*HELD_STATES), "not held").when(F.coalesce("_held", none) != F.col("blocks"), "other blocks")
    verdict = verdict.when(~F.coalesce("_proven", F.lit(True)), "no provenance").when(~F.coalesce("_fine", F.lit(True)), "damaged").otherwise("durable")
    return rows.select(*requests.columns, verdict.alias("verdict"))


#: A block written so shortly before a sweep may belong to a version that is not recorded yet.
GRACE_US = 10 * 60 * 1_000_000


def sweep(store: DataFrame, live: DataFrame, started_us: int, grace_us: int = GRACE_US) -> DataFrame:
    """store(hash, size, us) with verdict: live, young (written within the grace before the sweep, or after it), or swept.

    live: the column hash. This marks only; a dry run counts the verdicts, a real one deletes what is swept.
    """
    marked = store.join(live.select("hash").distinct().withColumn("_live", F.lit(True)), "hash", "left")
    verdict = F.when(F.col("_live"), "live").when(F.col("us") > F.lit(started_us - grace_us), "young").otherwise("swept")
    return marked.select("hash", "size", "us", verdict.alias("verdict"))


def triage(files: DataFrame, disk: DataFrame, intents: DataFrame, version_blocks: DataFrame, stored: DataFrame) -> DataFrame:
    """What became of live, hydrated files: ok, offline delete, or quarantine with reconstruct or demote.

    version_blocks(version_hash, hash) and stored(group_id, hash): a file is made again if the group's store has every block
    of its version; one with a missing block, or of a version without any, becomes a placeholder.
    """
    live = files.filter("state = 'current' AND NOT deleted AND materialization_state = 'hydrated'").select(*PATH, "size", "version_hash")
    rows = live.join(disk.select(*PATH, F.col("size").alias("d_size"), F.col("hash").alias("d_hash")), PATH, "left").join(intents.select(*PATH, F.lit(True).alias("open")), PATH, "left")
    wanted = live.select("group_id", "version_hash").distinct().join(version_blocks, "version_hash")
    has = wanted.join(stored.select("group_id", "hash", F.lit(True).alias("there")), ["group_id", "hash"], "left").groupBy("group_id", "version_hash").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("whole"))
    same = F.coalesce((F.col("d_size") == F.col("size")) & (F.col("d_hash") == F.col("version_hash")), F.lit(False))
    outcome = F.when(same, "ok").when(F.col("d_size").isNull() & F.col("open").isNull(), "offline delete").when(F.col("whole"), "reconstruct").otherwise("demote")
    return rows.join(has, ["group_id", "version_hash"], "left").select(*PATH, outcome.alias("outcome"), (F.col("d_size").isNotNull() & ~same).alias("quarantine"))


def set_digest(rows: DataFrame, keys: list[str], items: list[str], name: str = "digest") -> DataFrame:
    """A digest per key over the sorted, different items, each written as its columns joined by ':'.

    In two levels, so that no group has to fit in a row: items are dealt by the first two digits of their hashes, each
    part is digested, and the digest of a key is that of its parts' digests in order. Large groups take more digits.
    """
    text = F.concat_ws(":", *[F.coalesce(F.col(i).cast("string"), F.lit("-")) for i in items])
    parts = rows.select(*keys, F.sha2(text, 256).alias("_item")).withColumn("_part", F.substring("_item", 1, DIGITS))
    each = parts.groupBy(*keys, "_part").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("_item")), ","), 256).alias("_digest"))
    return each.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_part", "_digest"))), lambda x: x["_digest"]), ","), 256).alias(name))
