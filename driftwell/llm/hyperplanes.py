"""Near-duplicate vectors by random-hyperplane sign hashing.

A table of the hash has `bits` random hyperplanes; a vector's key in it is the side of each on which the vector lies. Two
vectors at an angle of t share a side with chance 1 - t / pi, so a pair at the threshold's angle meets in one of `tables`
tables but for a chance of MISS, and closer pairs much more surely. Vectors are compared only with vectors of their own
label and length (a "space"). A space of n different vectors gets so many bits that a bucket is expected to hold BUCKET
of them, LEAST_BITS at least, and the number of tables follows from the bits: work grows a little faster than n.

Equal vectors are one class, found by two 64-bit hashes of label and vector before anything else; a class counts as often
as it has rows. Every class is hashed once, and that table is cut, so all tables see the same keys. A bucket's vectors
meet in one task, which computes all cosines in blocks. Buckets of more than PIECE classes are dealt into pieces, every
pair of pieces to a task of its own; nothing is dropped. A pair that several tables find counts in the first of them only,
and is never written out: a task returns each class's number of links and a spanning forest of them. Components are
found by label propagation on these edges.

Defined results: null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing: n_links 0, a component of their own, kept. Vectors of different lengths never link. Equal rows link with each
other like any others; if their ids are equal too, all of them that carry the component's smallest id are kept. Null ids
come after all others as a component's smallest; a component of null ids only has a null id and keeps all its rows. Very
long vectors are read whole. An empty table gives an empty result. Further columns, whatever their names, are not returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import cut, few, read
from driftwell.llm.simhash import components, forest, whole_runs

SEED = 20
#: Chance to miss a pair at exactly the threshold.
MISS = 1e-4
#: Vectors that a bucket is expected to hold, and most of them that meet in one task.
BUCKET, PIECE = 512, 1024
LEAST_BITS, MOST_BITS = 4, 30
BLOCK = 512
CLASS = ["label", "h1", "h2"]


def tables_for(bits: int, cosine: float, miss: float = MISS) -> int:
    """Tables of so many bits in which a pair at the cosine meets at least once, but for a chance of `miss`."""
    side = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if side >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-side)))


def planes(dimension: int, bits: int, tables: int) -> np.ndarray:
    """(dimension, tables * bits): normals of the hyperplanes."""
    return np.random.default_rng([SEED, dimension, bits]).standard_normal((tables * bits, dimension)).T


def usable(label: Column, vector: Column) -> Column:
    """Whether a vector can link at all."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: pa.Array, n: int) -> np.ndarray:
    """The vectors, all of one length, as rows of length 1."""
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def signed(classes: DataFrame, cosine: float) -> DataFrame:
    """classes(node, m, space, dimension, bits, tables, vector) with keys: a vector's key in each table."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int, int], np.ndarray] = {}
        for b in found:
            shape = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dimension", "bits", "tables")], axis=1)
            keys: list[list[int]] = [[]] * b.num_rows
            for d, bits, tables in np.unique(shape, axis=0).tolist():
                at = np.flatnonzero((shape == (d, bits, tables)).all(axis=1))
                normals = known.setdefault((d, bits, tables), planes(d, bits, tables))
                sides = (unit(b.column("vector").take(pa.array(at)), len(at)) @ normals >= 0).reshape(len(at), tables, bits)
                for i, row in zip(at.tolist(), (sides @ (1 << np.arange(bits, dtype=np.int64))).tolist()):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("node", "m", "space", "vector")] + [pa.array(keys, pa.list_(pa.int32()))], names=["node", "m", "space", "vector", "keys"])

    kind = dict(classes.dtypes)["vector"]
    return classes.select("node", "m", "space", "vector", "dimension", "bits", "tables").mapInArrow(batches, f"node long, m long, space long, vector {kind}, keys array<int>")


def links_within(rows: pa.RecordBatch, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket, or of two of its pieces: how many links each row gets, and index pairs that span them.

    Only pairs of different pieces count where there are two, and only pairs that no earlier table has together.
    """
    n = rows.num_rows
    v = unit(rows.column("vector"), n)
    piece, m = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "m"))
    keys = rows.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)[:, : rows.column("slot")[0].as_py()]
    two = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
    counts = np.zeros(n, dtype=np.int64)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, n, BLOCK):
        i, j = np.nonzero(v[at : at + BLOCK] @ v[at:].T >= cosine)
        i, j = i[i < j] + at, j[i < j] + at
        fresh = piece[i] != piece[j] if two else np.ones(len(i), dtype=bool)
        for s in range(keys.shape[1]):
            fresh &= keys[i, s] != keys[j, s]
        i, j = i[fresh], j[fresh]
        np.add.at(counts, i, m[j])
        np.add.at(counts, j, m[i])
        us.append(i)
        vs.append(j)
    i, j = np.concatenate(us), np.concatenate(vs)
    if len(i) > 2 * n:
        linked = np.zeros((n, n), dtype=bool)
        linked[i, j] = linked[j, i] = True
        return counts, np.array(forest(n, lambda x, these: these[linked[x, these]]), dtype=np.int64).reshape(-1, 2)
    return counts, np.stack([i, j], axis=1)


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    value, name = F.col(f"`{vector}`"), F.col(f"`{label}`").cast("string")
    own = [F.col(f"`{vec_id}`").alias("vec_id"), F.when(usable(name, value), name).alias("label"), F.xxhash64(value).alias("h1"), F.xxhash64(F.lit("second"), value).alias("h2")]
    able = rows.select(*own, value.alias("vector")).filter("label IS NOT NULL")
    classes = able.groupBy(*CLASS).agg(F.count("*").alias("m"), F.min("vec_id").alias("smallest"), F.first("vector").alias("vector"))
    classes = cut(classes.withColumn("dimension", F.size("vector")).withColumn("node", F.monotonically_increasing_id()))

    sizes = cut(classes.groupBy("label", "dimension").agg(F.count("*").alias("n")).withColumn("space", F.monotonically_increasing_id()))
    wanted = F.ceil(F.log2(F.col("n") / F.lit(float(BUCKET))))
    bits = F.greatest(F.lit(LEAST_BITS), F.least(F.lit(MOST_BITS), wanted)).cast("int")
    tables = F.element_at(F.array(*[F.lit(tables_for(b, cosine)) for b in range(1, MOST_BITS + 1)]), bits)
    spaces = sizes.select("label", "dimension", "space", bits.alias("bits"), tables.alias("tables"))
    hashed = cut(signed(classes.join(few(spaces), ["label", "dimension"]), cosine))

    bucket = ["space", "slot", "key"]
    slim = hashed.select("space", F.posexplode("keys").alias("slot", "key"))
    hot = cut(slim.groupBy(*bucket).agg(F.count("*").alias("n")).filter(F.col("n") > PIECE).select(*bucket, F.ceil(F.col("n") / F.lit(PIECE)).cast("int").alias("pieces")))
    each = hashed.select("node", "m", "space", "vector", "keys", F.posexplode("keys").alias("slot", "key")).join(few(hot), bucket, "left")
    each = each.withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("pieces"))).cast("int"))
    others = F.when(F.col("pieces").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("pieces") - 1))
    each = each.withColumn("_other", F.explode(others)).withColumn("low", F.least("piece", "_other")).withColumn("high", F.greatest("piece", "_other"))
    run = [*bucket, "low", "high"]
    dealt = each.select(*run, "piece", "node", "m", "vector", "keys").repartition(*run).sortWithinPartitions(*run)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts, lengths in whole_runs(found, run):
            nodes = b.column("node").to_numpy(zero_copy_only=False)
            out: list[list[np.ndarray]] = [[nodes[:0]], [nodes[:0]], [nodes[:0]]]
            for s, n in zip(starts[lengths > 1].tolist(), lengths[lengths > 1].tolist()):
                counts, pairs = links_within(b.slice(s, n), cosine)
                some, mine = np.flatnonzero(counts), nodes[s : s + n]
                for column, values in zip(out, ([mine[some], mine[pairs[:, 0]]], [np.full(len(some), -1), mine[pairs[:, 1]]], [counts[some], np.zeros(len(pairs), np.int64)])):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["a", "b", "n"])

    found = cut(dealt.mapInArrow(batches, "a long, b long, n long"))
    links = found.filter("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    reach = components(found.filter("b >= 0").select("a", "b").distinct())
    labelled = classes.select("node", *CLASS, "m", "smallest").join(links, "node", "left").join(reach.withColumnRenamed("label", "reached"), "node", "left").withColumn("reached", F.coalesce("reached", "node"))
    ids = labelled.groupBy("reached").agg(F.min("smallest").alias("component_id"))
    membership = labelled.join(ids, "reached").select(*CLASS, (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("_able"))
    out = rows.select(*own).join(membership, CLASS, "left")
    component = F.when(F.col("_able"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op13_hyperplane_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


#: By all pairs within a label.
OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_sum(list_transform(generate_series(1, len(a.e)), lambda i: a.e[i] * b.e[i])) / (a.norm * b.norm) >= 0.93),
reach(node, other) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.node, p.b FROM reach r JOIN pair p ON p.a = r.other),
low AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM u JOIN low ON low.node = u.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM pair GROUP BY a) c ON c.a = u.vec_id
"""
