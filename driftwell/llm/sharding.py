"""Sharding by sampled splitters.

Every row gets a sort key: 43 bits of its text's hash, then 20 bits of its id's hash. Equal texts are neighbours in key
order, and a large group of them still has up to a million different keys, so it can be divided like any other stretch.
A size-weighted sample of keys gives quantile boundaries of many small ranges; ranges that turn out overfull are
sampled again and subdivided; consecutive ranges then make up the shards.

Defined results: null text has size 1 (no bytes, plus 1) and CRC 0; a null id hashes like any value; rows that are equal
in both text and id have one key and stay in one range; an empty table gives an empty result; further columns, whatever
their names, are carried along or dropped by `keep`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.llm.common import cut, empty_if_null, read

SEED = 7


def sort_key(text: str, doc_id: str) -> Column:
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.col(text)), 21), 20)
    return high.bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col(doc_id)), 44))


def size_of(text: str) -> Column:
    return (F.octet_length(empty_if_null(text)) + F.lit(1)).cast("long")


def sample_splitters(keys: DataFrame, weight: float, per_range: int) -> np.ndarray:
    """Boundaries between ranges of about `weight` bytes, from a sample that takes a row with a chance in proportion to its size.

    A row as large as a sampling step is always taken and counts with its own size; any other counts as one step. The
    sample holds about per_range rows for each range.
    """
    step = weight / per_range
    chance = F.pmod(F.xxhash64("key", "size", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = keys.filter(chance * F.lit(step) < F.col("size")).select("key", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("w")).toPandas()
    if rows.empty:
        return np.zeros(0, np.int64)
    rows = rows.sort_values("key", kind="stable")
    at = np.floor(rows["w"].cumsum().to_numpy() / weight).astype(np.int64)
    return np.unique(rows["key"].to_numpy()[np.flatnonzero(np.diff(at, prepend=0) > 0)])


def range_of(splitters: np.ndarray):
    """A column function: the number of splitters that are not above the key."""
    bounds = np.asarray(splitters, dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def number(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

    return number


def shard(docs: DataFrame, n_shards: int = 8, ranges_per_shard: int = 256, sample_per_range: int = 16, rows_per_range: int = 1_000_000, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows of docs (or their columns `keep`) with size, shard and slot; shards are near equal in bytes.

    n_shards * ranges_per_shard ranges are cut, or more where a range would hold over rows_per_range rows. What reaches
    the driver is the sample and one row of counts per range, so a few bytes for every rows_per_range / sample_per_range
    input rows at scale.
    """
    kept = docs.columns if keep is None else keep
    keys = cut(docs.select(sort_key(text, doc_id).alias("key"), size_of(text).alias("size")))
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = max(n_shards * ranges_per_shard, -(-rows // rows_per_range))
    weight = max(total / n_ranges, 1.0)
    bounds = sample_splitters(keys, weight, sample_per_range)
    for _ in range(3):
        counts = keys.groupBy(range_of(bounds)("key").alias("number")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")).toPandas()
        full = counts[(counts["bytes"] > 2 * weight) & (counts["low"] < counts["high"])]
        if full.empty:
            break
        spark = docs.sparkSession
        # Only the overfull ranges are sampled again, eight times as densely. There are at most n_ranges / 2 of them.
        numbers = spark.createDataFrame(full[["number"]].astype("int32"), "number int")
        inside = keys.withColumn("number", range_of(bounds)("key")).join(F.broadcast(numbers), "number")
        more = np.unique(np.concatenate([bounds, sample_splitters(inside, weight / 2, 8 * sample_per_range)]))
        if len(more) == len(bounds):
            break
        bounds = more
    else:
        counts = keys.groupBy(range_of(bounds)("key").alias("number")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas()
    counts = counts.sort_values("number")
    before = counts["bytes"].cumsum() - counts["bytes"]
    counts["_shard"] = np.minimum((before + counts["bytes"] / 2) * n_shards // max(total, 1), n_shards - 1).astype("int32")
    counts["_offset"] = (counts.groupby("_shard")["rows"].cumsum() - counts["rows"]).astype("int64")
    places = docs.sparkSession.createDataFrame([tuple(map(int, x)) for x in counts[["number", "_shard", "_offset"]].to_numpy()], "_range int, _shard int, _offset long")
    inner = {c: f"_in_{i}" for i, c in enumerate(kept)}
    body = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in kept], sort_key(text, doc_id).alias("_key"), size_of(text).alias("_size"), F.crc32(empty_if_null(text).cast("binary")).alias("_crc"), F.xxhash64(F.col(text), F.col(doc_id)).alias("_tie"))
    within = Window.partitionBy("_range").orderBy("_key", "_tie")
    placed = body.withColumn("_range", range_of(bounds)("_key")).withColumn("_nth", F.row_number().over(within)).join(F.broadcast(places), "_range")
    added = [F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"), (F.col("_offset") + F.col("_nth") - 1).cast("long").alias("slot")]
    return placed.select(*[F.col(inner[c]).alias(c) for c in kept if c not in ("size", "text_crc32", "shard", "slot")], *added)


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
