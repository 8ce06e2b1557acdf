"""Content-defined chunks of files that no task holds whole.

A file is rows of consecutive bytes, of any sizes. Where a chunk may end depends on the last WINDOW bytes only, so a file is
searched in stretches of STRETCH bytes, each by itself with WINDOW - 1 bytes of the one before; a stretch's rows stream through
in order, and the last bytes of a row are carried to the next. Which of these places end chunks depends on the chunk before;
a file's places, one for an average chunk, go in order through a fold that remembers where the last chunk ended. Bytes meet
again chunk by chunk for their hashes, so the most that is ever held is a row and a largest chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.plans.lineage import cut

WINDOW = 48
STRETCH = 64 << 20
#: Bytes of a file's cell, by which pieces and chunks meet.
CELL = 1 << 20
TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)


def mask_for(smallest: int, average: int) -> int:
    return (1 << max(average - smallest, 2).bit_length() - 1) - 1


def places(data: np.ndarray, mask: int) -> np.ndarray:
    """After how many bytes the rolling hash of the last WINDOW bytes hits the mask."""
    h = np.zeros(len(data), dtype=np.uint64)
    for k in range(min(WINDOW, len(data))):
        h[k:] += TABLE[data[: len(data) - k]] << np.uint64(k)
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64(mask) == 0) + 1


def pieces(rows: DataFrame, size: int, before: int) -> DataFrame:
    """rows(file, start, data) cut to parts of `size` bytes of the file, each with `before` bytes more of what comes before it: part, at, data."""
    last = F.col("start") + F.length("data") - 1
    parts = rows.filter(F.length("data") > 0).withColumn("part", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((last + before) / size))))
    begin = F.greatest(F.col("start"), F.col("part") * size - before)
    end = F.least(last + 1, (F.col("part") + 1) * size)
    whole = parts.withColumns({"at": begin.cast("long"), "_end": end.cast("long")}).filter("at < _end")
    return whole.select("file", "part", "at", F.substring("data", (F.col("at") - F.col("start") + 1).cast("int"), (F.col("_end") - F.col("at")).cast("int")).alias("data"))


def stream_chunks(splits: DataFrame, smallest: int = 512 << 10, average: int = 2 << 20, largest: int = 8 << 20, stretch: int = STRETCH, cell: int = CELL) -> DataFrame:
    """(file, ord, start, size, hash) of splits(file, nth, data): a file's bytes are those of its splits in order.

    The chunks are the same for any splits of the same bytes. Null data is empty; empty files have no chunks.
    """
    mask = mask_for(smallest, average)
    order = Window.partitionBy("file").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    data = F.coalesce("data", F.lit(b""))
    rows = cut(splits.select("file", "nth", data.alias("data")).withColumn("start", F.coalesce(F.sum(F.length("data")).over(order), F.lit(0)).cast("long")).select("file", "start", "data"))
    kind = dict(rows.dtypes)["file"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tail = None, np.zeros(0, np.uint8)
        for b in batches:
            files, ats = [], []
            for file, part, at, raw in zip(*[b.column(c).to_pylist() for c in ("file", "part", "at", "data")]):
                if (file, part) != here:
                    here, tail = (file, part), np.zeros(0, np.uint8)
                own = np.concatenate([tail, np.frombuffer(raw, dtype=np.uint8)])
                hits = places(own, mask) - len(tail) + at
                # Places in the bytes before a stretch are the other stretch's; those in the tail were found already.
                hits = hits[hits > max(at, part * stretch)]
                files += [file] * len(hits)
                ats += hits.tolist()
                tail = own[-(WINDOW - 1) :]
            yield pa.RecordBatch.from_arrays([pa.array(files, b.schema.field("file").type), pa.array(ats, pa.int64())], names=["file", "at"])

    stretches = pieces(rows, stretch, WINDOW - 1).repartition("file", "part").sortWithinPartitions("file", "part", "at")
    hits = stretches.mapInArrow(found, f"file {kind}, at long")
    ends = rows.groupBy("file").agg(F.max(F.col("start") + F.length("data")).alias("at")).filter("at > 0")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, begin, ord_ = None, 0, 0
        for b in batches:
            out: list[tuple] = []
            for file, at, last in zip(*[b.column(c).to_pylist() for c in ("file", "at", "last")]):
                if file != here:
                    here, begin, ord_ = file, 0, 0
                # Up to this place nothing ends a chunk but its greatest size.
                while at - begin > largest or (at - begin == largest and not last):
                    out.append((file, ord_, begin, largest))
                    begin, ord_ = begin + largest, ord_ + 1
                if (last and at > begin) or at - begin >= smallest:
                    out.append((file, ord_, begin, at - begin))
                    begin, ord_ = at, ord_ + 1
            kinds = [b.schema.field("file").type, pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["file", "ord", "start", "size"])

    marks = cut(hits.withColumn("last", F.lit(False)).unionByName(ends.withColumn("last", F.lit(True))))
    chunks = cut(marks.repartition("file").sortWithinPartitions("file", "at", "last").mapInArrow(folded, f"file {kind}, ord long, start long, size long"))

    spread = chunks.withColumn("part", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("start") + F.col("size") - 1) / cell))))
    met = pieces(rows, cell, 0).join(spread, ["file", "part"]).filter((F.col("at") < F.col("start") + F.col("size")) & (F.col("at") + F.length("data") > F.col("start")))
    begin = F.greatest("at", "start")
    end = F.least(F.col("at") + F.length("data"), F.col("start") + F.col("size"))
    slices = met.select("file", "ord", "start", "size", begin.alias("at"), F.substring("data", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("data"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, digest = None, hashlib.sha256()
        for b in batches:
            out: list[tuple] = []
            for *own, raw in zip(*[b.column(c).to_pylist() for c in ("file", "ord", "start", "size", "data")]):
                if own != here:
                    if here is not None:
                        out.append((*here, digest.hexdigest()))
                    here, digest = own, hashlib.sha256()
                digest.update(raw)
            kinds = [b.schema.field("file").type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["file", "ord", "start", "size", "hash"])
        if here is not None:
            kinds = [b.schema.field("file").type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*here, digest.hexdigest()), kinds)], names=["file", "ord", "start", "size", "hash"])

    sent = slices.repartition("file", "ord").sortWithinPartitions("file", "ord", "at").select("file", "ord", "start", "size", "data")
    return sent.mapInArrow(digested, f"file {kind}, ord long, start long, size long, hash string")


def shift_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, bytes_before, bytes_after, bytes_kept): of each file's chunks after a change, those whose hashes it had before."""
    old = before.select("file", "hash").distinct().withColumn("kept", F.lit(True))
    kept = after.join(old, ["file", "hash"], "left").groupBy("file").agg(F.sum("size").alias("bytes_after"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("size"))), F.lit(0)).alias("bytes_kept"))
    return before.groupBy("file").agg(F.sum("size").alias("bytes_before")).join(kept, "file", "full_outer")
