"""Set digests as Merkle trees, and sets interned under their digests.

An item is placed by the hexadecimal digits of its SHA-256. A node of at most LEAF items is a leaf and digests their hashes in
order; a larger one digests its children, one for each next digit. So the tree follows from the set alone, its fan-out
grows with the number of items, no row holds more than LEAF items or 16 children, and adding items changes only the leaves
they fall into and the nodes above these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.plans.lineage import cut

LEAF = 64
#: Nodes of more items are told by counts alone, so that their items are not gathered in one task.
BULK = 1 << 16


def hashed(items: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """(keys, item): the different items as SHA-256 of their columns, joined by ':'; null is '-'."""
    return unpacked(packed_items(items, keys, *columns))


def packed_items(items: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """The same with 32 bytes for the 64 digits, as which they travel. Their order is that of the digits."""
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    return items.select(*keys, F.unhex(F.sha2(text, 256)).alias("item")).distinct()


def packed(items: DataFrame) -> DataFrame:
    return items.withColumn("item", F.unhex("item"))


def unpacked(items: DataFrame) -> DataFrame:
    return items.withColumn("item", F.lower(F.hex("item")))


def prefix(depth: int) -> Column:
    return F.substring(F.lower(F.hex("item")), 1, depth)


def subtrees(items: DataFrame, keys: list[str], leaf: int = LEAF, bulk: int = BULK) -> DataFrame:
    """(keys, prefix, n, digest) of all nodes at and below `start`, a column of items(keys, item, start) that no two nest in.

    items are packed and cut. A level deals them out by node once: small nodes become leaves there, the others' items go on.
    """
    bounds = items.agg(F.coalesce(F.min(F.length("start")), F.lit(0)), F.coalesce(F.max(F.length("start")), F.lit(0))).first()
    depth, deepest = int(bounds[0]), int(bounds[1])
    levels, inner, rest, node = [], [], items, [*keys, "prefix"]
    while True:
        here = rest.withColumn("prefix", prefix(depth))
        # Items whose tree begins deeper wait for their depth.
        waiting = here.filter(F.length("start") > depth) if depth < deepest else None
        if waiting is not None:
            here = here.filter(F.length("start") <= depth)
        huge = cut(here.groupBy(*node).agg(F.count("*").alias("n")).filter(F.col("n") > bulk).select(*node))
        whole = None
        if not huge.isEmpty():
            whole, here = here.join(F.broadcast(huge), node, "left_semi"), here.join(F.broadcast(huge), node, "left_anti")
        sized = here.withColumn("n", F.count("*").over(Window.partitionBy(*node)))
        text = F.array_join(F.transform(F.sort_array(F.collect_list("item")), lambda x: F.lower(F.hex(x))), ",")
        small = sized.filter(F.col("n") <= leaf).groupBy(*node).agg(F.max("n").alias("n"), F.sha2(F.concat(F.lit("leaf:"), text), 256).alias("digest"), F.max("start").alias("start"))
        found = cut(small.unionByName(sized.filter(F.col("n") > leaf).select(*node, "item", "start"), allowMissingColumns=True))
        levels.append(found.filter("item IS NULL").select(*node, "n", "digest"))
        rest = found.filter("item IS NOT NULL").select(*keys, "item", "start", "prefix")
        rest = rest if whole is None else rest.unionByName(whole.select(*rest.columns))
        inner.append((depth, rest.select(*node).distinct() if depth < deepest else None))
        rest = rest.drop("prefix") if waiting is None else rest.drop("prefix").unionByName(waiting.drop("prefix"))
        if rest.isEmpty():
            break
        depth += 1
    nodes = reduce(DataFrame.unionByName, levels)
    for depth, large in reversed(inner[:-1]):
        above = parents(nodes.filter(F.length("prefix") == depth + 1), keys, depth)
        # Above where a tree begins there are nodes of other trees only.
        nodes = nodes.unionByName(cut(above if large is None else above.join(large, node, "left_semi")))
    return nodes  # of parts that are all cut


def parents(children: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """The nodes at a depth, from all their children."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("prefix", "digest"))), lambda c: F.concat(F.substring(c["prefix"], depth + 1, 1), c["digest"])), ",")
    return children.groupBy(*keys, F.substring("prefix", 1, depth).alias("_up")).agg(F.sum("n").alias("n"), F.sha2(F.concat(F.lit("node:"), text), 256).alias("digest")).withColumnRenamed("_up", "prefix")


def tree(items: DataFrame, keys: list[str], leaf: int = LEAF) -> DataFrame:
    """All nodes over items(keys, item), which are different; the root has the empty prefix."""
    return packed_tree(packed(items), keys, leaf)


def packed_tree(items: DataFrame, keys: list[str], leaf: int = LEAF) -> DataFrame:
    """`tree` over packed items."""
    return subtrees(cut(items.withColumn("start", F.lit(""))), keys, leaf)


def roots(nodes: DataFrame, keys: list[str], name: str = "digest") -> DataFrame:
    return nodes.filter("prefix = ''").select(*keys, F.col("digest").alias(name))


def added(nodes: DataFrame, items: DataFrame, fresh: DataFrame, keys: list[str], leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """The tree over items and fresh, and the nodes that were worked out anew. nodes is the tree over items.

    Only the leaves that fresh items fall into are built again, from their items; above them each node is digested again
    from its children's digests. fresh items that are there already change nothing.
    """
    fresh = cut(fresh.join(items, [*keys, "item"], "left_anti").distinct())
    deepest = int(nodes.agg(F.coalesce(F.max(F.length("prefix")), F.lit(0))).first()[0])
    along = fresh.withColumn("_depth", F.explode(F.sequence(F.lit(0), F.lit(deepest)))).withColumn("prefix", F.expr("substring(item, 1, _depth)"))
    last = along.join(nodes.select(*keys, "prefix", (F.col("n") <= leaf).alias("_leaf")), [*keys, "prefix"]).groupBy(*keys, "item").agg(F.max(F.struct("_depth", "_leaf")).alias("l"))
    # Below an inner node without that child a leaf begins; without a tree, the root does.
    begin = F.when(F.col("l").isNull(), 0).when(F.col("l._leaf"), F.col("l._depth")).otherwise(F.col("l._depth") + 1)
    placed = cut(fresh.join(last, [*keys, "item"], "left").select(*keys, "item", F.substring("item", F.lit(1), begin).alias("start")))
    starts = cut(placed.select(*keys, "start").distinct())
    old = items.withColumn("_depth", F.explode(F.sequence(F.lit(0), F.lit(deepest)))).withColumn("start", F.expr("substring(item, 1, _depth)")).join(starts, [*keys, "start"], "left_semi").select(*keys, "item", "start")
    built = subtrees(cut(packed(placed.unionByName(old))), keys, leaf)
    kept = cut(nodes.join(starts.withColumnRenamed("start", "prefix"), [*keys, "prefix"], "left_anti"))
    anew = built
    for depth in range(deepest, -1, -1):
        up = starts.filter(F.length("start") > depth).select(*keys, F.substring("start", 1, depth).alias("prefix")).distinct()
        if up.isEmpty():
            continue
        kept = cut(kept.join(up, [*keys, "prefix"], "left_anti"))
        below = kept.unionByName(anew).filter(F.length("prefix") == depth + 1).withColumn("_up", F.substring("prefix", 1, depth)).join(up.withColumnRenamed("prefix", "_up"), [*keys, "_up"], "left_semi").drop("_up")
        anew = cut(anew.unionByName(parents(below, keys, depth)))
    return cut(kept.unionByName(anew)), anew


def frontier_items(entries: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of entries(keys, path, heads): an item for each path with its sorted, different heads.

    A path with two entries is an error of its key, with the smallest such path; nothing is merged.
    """
    twice = cut(entries.groupBy(*keys, "path").agg(F.count("*").alias("n")).filter("n > 1").groupBy(*keys).agg(F.min("path").alias("twice")))
    own = entries.withColumn("_heads", F.array_sort(F.array_distinct("heads"))).select(*keys, "path", F.size("_heads").alias("_n"), F.array_join("_heads", ",").alias("_text"))
    return hashed(own, keys, "path", "_n", "_text"), twice


def basis(members: Column, group: Column) -> Column:
    """The name of a set of changes: its group, and a digest of the sorted, different members."""
    text = F.concat_ws(":", group.cast("string"), F.size(F.array_distinct(members)).cast("string"), F.array_join(F.array_sort(F.array_distinct(members)), ","))
    return F.concat_ws(":", group.cast("string"), F.sha2(text, 256))


def interned(known: DataFrame | None, sets: DataFrame, batch: int) -> DataFrame:
    """known(basis_id, group_id, members, batch) with the sets(group_id, members) that it lacks, each once."""
    named = sets.select(basis(F.col("members"), F.col("group_id")).alias("basis_id"), "group_id", F.array_sort(F.array_distinct("members")).alias("members"), F.lit(batch).cast("long").alias("batch")).dropDuplicates(["basis_id"])
    return named if known is None else known.unionByName(named.join(known, "basis_id", "left_anti"))
