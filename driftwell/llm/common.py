"""What the operators of this subpackage share: reading tables, cutting lineage, and splitting text batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.plans.lineage import cut, few, shared_folder  # noqa: F401  for the modules here

#: White space as the contracts write it: [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(docs: DataFrame, row: str | None = None, **columns: Column) -> DataFrame:
    """(row, columns...): the given columns, each row with a number of its own.

    The numbers are those of the column `row`, or new ones where that is None. Numbers that are made anew follow how the
    input is split, which can differ from one scan to the next; so what uses them twice has to cut this first.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    return docs.select(number.alias("row"), *[c.alias(name) for name, c in columns.items()])


def empty_if_null(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def crc_of_id(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and where each begins and ends (one more than there are texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross a text's end: starts, ends, and the index of each run's text."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | fresh[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def pieces(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs as an Arrow array of binary values."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    body = np.ascontiguousarray(data[inside])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """White-space separated words of all texts, and the index of each word's text."""
    inside = ~SPACE[data]
    starts, ends, owner = runs(inside, offsets)
    return pieces(data, inside, starts, ends), owner


def per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights=weights, minlength=n)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in row ranges of about `most` bytes of text, so that work arrays stay small; a longer text comes alone.

    What the batches took goes back to the system at the end: a worker lives on, and would hold it beside the next stages.
    """
    for b in batches:
        sizes = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = total = 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > most:
                yield b.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        if begin < b.num_rows:
            yield b.slice(begin)
        del b
    pa.default_memory_pool().release_unused()
