"""A corpus pipeline over documents: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and
reads again as the next stage's docs. All but the last return the columns of documents.

Defined results, for every stage: docs needs the columns doc_id, text, lang and source; further ones are carried along
under any names (they stand aside in a struct while an operator works), though the last stage replaces columns named
size, shard and slot. Null and empty texts are rejected by the first stage; where a stage gets them anyway, they are near
duplicates of each other, are not contaminated, have size 0 and so are not taken by the mix, and are sharded as size 1.
Null and repeated ids are kept apart by the rows' texts and numbers. Of rows that are equal near-dedup keeps one; the
other stages treat them one by one. Training positions live in the order of the mixed rows, and a shard's slots follow it. Ties: near-dedup keeps the smallest id, then the first row. Very long texts are read
whole. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.llm.common import cut, few, numbered, read, shared_folder
from driftwell.llm.decontaminate import decontaminate
from driftwell.llm.mixing import in_training_order, mix
from driftwell.llm.quality_rules import judge
from driftwell.llm.sharding import shard
from driftwell.llm.simhash import similar

#: Not expressible in SQL: the first stage splits words with a tokeniser's vocabulary.
ORACLE_SQL: str | None = None
REST = "_rest"


def aside(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct, where no operator's columns clash with them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(F.lit(0).alias("_"), *others).alias(REST))


def together(df: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of docs again."""
    return df.select(*[F.col(c) if c in needed else F.col(REST)[c].alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Whole rows pass through the tasks here, so these hold less text and fewer words."""
    needed = ("text", "lang")
    return together(judge(aside(docs, *needed), language="lang", slice_bytes=1 << 19, words_known=40_000).filter("kept"), docs, *needed)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8), the one with the smallest id.

    The rows are written once with their numbers; the operator and the result both read that table.
    """
    needed = ("doc_id", "text")
    rows = cut(numbered(aside(docs, *needed), **{c: F.col(c) for c in (*needed, REST)}))
    found = similar(rows.select("row", "text"))
    groups = found.join(found.groupBy("label").count().filter("count > 1").select("label"), "label").join(rows.select("row", "doc_id"), "row")
    first = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    gone = cut(groups.select("row").join(first, "row", "left_anti"))
    return together(rows.join(few(gone), "row", "left_anti"), docs, *needed)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. The rows are written once with their numbers."""
    needed = ("doc_id", "text")
    rows = cut(numbered(aside(docs, *needed), **{c: F.col(c) for c in (*needed, REST)}))
    found = decontaminate(rows, read(spark, sf_dir, "benchmark"), row="row")
    return together(rows.join(few(cut(found.filter("contaminated").select("row"))), "row", "left_anti"), docs, *needed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, every copy at its own training position, in training order."""
    needed = ("doc_id", "text", "source")
    return together(in_training_order(mix(aside(docs, *needed), whole=True)), docs, *needed)


def with_places(docs: DataFrame, *needed: str) -> DataFrame:
    """aside(docs, *needed) with _file, _part and _nth: where in its files a row stands. Files are in order of their numbers.

    Rows that are not read from files stand in the order in which they come.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    columns = [*needed, F.struct(F.lit(0).alias("_"), *others).alias(REST)]
    number = F.expr("coalesce(try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) AS bigint), -1)")
    try:
        return docs.select(*columns, F.col("_metadata.file_name").alias("_file"), number.alias("_part"), F.col("_metadata.row_index").alias("_nth"))
    except AnalysisException:
        return cut(docs.select(*columns, F.lit("").alias("_file"), F.lit(0).cast("long").alias("_part"), F.monotonically_increasing_id().alias("_nth")))


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, shard and slot. A shard's slots follow the order of the rows in docs, which is that of training.

    Rows are told apart by their place in the files; only places and sizes are dealt and counted, then texts join them once.
    """
    place = ["_file", "_part", "_nth"]
    rows = with_places(docs, "doc_id", "text")
    dealt = cut(shard(rows.select(*place, "doc_id", "text"), keep=place).select(*place, "size", "shard"))
    before = Window.partitionBy("shard").orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_file", "_part", "shard").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = Window.partitionBy("_file", "_part", "shard").orderBy("_nth")
    slots = dealt.withColumn("_at", F.row_number().over(within)).join(counts.drop("_n"), ["_file", "_part", "shard"])
    slots = slots.select(*place, "size", "shard", (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"))
    own = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    joined = rows.join(slots, place)
    return joined.select(*[F.col(c) if c in ("doc_id", "text") else F.col(REST)[c].alias(c) for c in own], "size", "shard", "slot")


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_to_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
