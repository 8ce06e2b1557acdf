"""Benchmark decontamination by winnowing.

A text's words are lower-cased runs of letters, digits and non-ASCII characters. Each run of K words has a hash, and of
every W consecutive hashes the smallest is kept. K + W - 1 is the length of a window (13 words), so two texts that share
a window share a kept hash: none can be missed.

The benchmark's kept hashes set bits of a map of fixed size (2^24 bits, 2 MB at most, whatever the benchmark's size), which
goes to every task. A document's kept hashes that meet a set bit are hits; each is extended to the windows around it,
and these windows' words are joined, as text, with the benchmark's windows. So chance agreement costs a few rows and
never changes a result. An item shorter than a window is one window of its own length; its whole hash goes into the map,
and documents are probed with all runs of that length. Which side of the join is broadcast, if any, is left to the
runtime's measured sizes.

Defined results: null and wordless texts have no words, no hits and are clean; null or wordless items have no windows;
repeated items count once per item_id; repeated rows are judged one by one; a very long text is read whole, alone in its
slice; an empty benchmark leaves all clean; of both tables only the named columns are read, so further columns may have
any names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.llm.common import cut, lower_ascii, numbered, read, runs, slices, text_bytes

K, W = 7, 7
SPAN = K + W - 1
MAP_BITS = 24
WORD = np.zeros(256, dtype=bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Odd multipliers of the word hash, its inverse, the run hash, and a bit mixer.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEP = 0xC2B2AE3D27D4EB4F
MIX = 0xFF51AFD7ED558CCD


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from one running sum over all bytes."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=total[1:])
    return mixed((total[ends] - total[starts]) * powers(INVERSE, len(data) + 1)[starts])


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each `length` consecutive words; as many as there are words, the last ones being without meaning."""
    out = np.zeros(len(words), dtype=np.uint64)
    n = len(words) - length + 1
    if n > 0:
        for j in range(length):
            out[:n] = out[:n] * np.uint64(STEP) + words[j : j + n]
    return mixed(out ^ np.uint64(length))


def kept_hashes(hashes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Positions kept by winnowing. room: at each word, how many words its text still has, itself included."""
    n = len(hashes)
    full = np.flatnonzero(room >= SPAN)
    if not len(full):
        return full
    least = hashes[full].copy()
    for j in range(1, W):
        np.minimum(least, hashes[full + j], out=least)
    keep = np.zeros(n, dtype=bool)
    for j in range(W):
        at = full + j
        keep[at[hashes[at] == least]] = True
    return np.flatnonzero(keep)


def split(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, the first word of each text (and the end), and each word's room."""
    data, offsets = text_bytes(texts)
    data = lower_ascii(data)
    starts, ends, owner = runs(WORD[data], offsets)
    first = np.searchsorted(owner, np.arange(len(offsets)))
    room = first[owner + 1] - np.arange(len(owner))
    return data, starts, ends, first, room


def window_text(body: bytes, starts: np.ndarray, ends: np.ndarray, at: int, length: int) -> str:
    return b" ".join(body[a:b] for a, b in zip(starts[at : at + length].tolist(), ends[at : at + length].tolist())).decode("utf-8", "replace")


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, words, length, slots): every window of every item, and the map bits that its item keeps."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(found):
            data, starts, ends, first, room = split(b.column("text"))
            body = data.tobytes()
            word = word_hashes(data, starts, ends)
            runs_k = run_hashes(word, K)
            keep = kept_hashes(runs_k, room)
            rows = {"item_id": [], "words": [], "length": [], "slots": []}
            for i, name in enumerate(b.column("item_id").to_pylist()):
                lo, hi = int(first[i]), int(first[i + 1])
                if hi == lo:
                    continue
                length = min(SPAN, hi - lo)
                if length < SPAN:
                    own = slots(run_hashes(word[lo:hi], length)[:1])
                else:
                    own = slots(runs_k[keep[(keep >= lo) & (keep < hi)]])
                for at in range(lo, hi - length + 1):
                    rows["item_id"].append(name)
                    rows["words"].append(window_text(body, starts, ends, at, length))
                    rows["length"].append(length)
                    rows["slots"].append(own.tolist() if at == lo else [])
            yield pa.RecordBatch.from_arrays([pa.array(rows["item_id"], pa.string()), pa.array(rows["words"], pa.string()), pa.array(rows["length"], pa.int32()), pa.array(rows["slots"], pa.list_(pa.int64()))], names=list(rows))

    return benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).mapInArrow(batches, "item_id string, words string, length int, slots array<long>")


def bit_map(windows: DataFrame) -> np.ndarray:
    """The map of kept hashes: at most 2^18 rows of 64 bits come to the driver, for a benchmark of any size."""
    bits = windows.select(F.explode("slots").alias("s")).groupBy(F.shiftright("s", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    out[bits["cell"].to_numpy(dtype=np.int64)] = bits["bits"].to_numpy(dtype=np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def candidates(docs: DataFrame, bits: np.ndarray, short: list[int], doc_id: str, text: str, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_words, found): one row per document; found holds (at, length, words) of the windows around its hits."""
    packed = np.packbits(bits, bitorder="little")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(packed, bitorder="little").view(bool)
        for b in slices(found):
            data, starts, ends, first, room = split(b.column("text"))
            word = word_hashes(data, starts, ends)
            hashes = run_hashes(word, K)
            keep = kept_hashes(hashes, room)
            keep = keep[known[slots(hashes[keep])]]
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            # A kept run of K words lies in the windows that begin up to SPAN - K words before it.
            at = np.unique((keep[:, None] - np.arange(SPAN - K + 1)[None, :]).ravel()) if len(keep) else keep
            near = np.unique((at >= 0) * at)
            near = near[room[near] >= SPAN] if len(near) else near
            spots = [(near, SPAN)]
            for m in short:
                h = run_hashes(word, m)
                where = np.flatnonzero(room >= m)
                spots.append((where[known[slots(h[where])]], m))
            body = data.tobytes() if any(len(x) for x, _ in spots) else b""
            out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
            for where, m in spots:
                for x in where.tolist():
                    out[owner[x]].append({"at": x - int(first[owner[x]]), "length": m, "words": window_text(body, starts, ends, x, m)})
            kind = pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32()), ("words", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(out, kind)], names=["row", "doc_id", "n_words", "found"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = numbered(docs, row, doc_id=F.col(doc_id), text=F.col(text))
    return rows.mapInArrow(batches, f"row long, doc_id {kind}, n_words long, found array<struct<at:int,length:int,words:string>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", row: str | None = None) -> DataFrame:
    """(row, doc_id, n_words, n_hit, n_items, items, contaminated), one row per document; items: sorted ids as text.

    row: the column of docs with a number of each row, if it is to be given back.
    """
    windows = cut(benchmark_windows(benchmark, item_id, item_text))
    bits = bit_map(windows)
    short = [r[0] for r in windows.filter(F.col("length") < SPAN).select("length").distinct().collect()]  # 12 at most
    docs_found = cut(candidates(docs, bits, short, doc_id, text, row))
    spots = docs_found.select("row", F.explode("found").alias("f")).select("row", "f.at", "f.length", "f.words")
    known = windows.select("words", "length").distinct()
    hits = cut(spots.join(known, ["words", "length"]))
    order = Window.partitionBy("row").orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("length")
    covered = hits.select("row", "at", "length").withColumn("before", F.coalesce(F.max(end).over(order), F.lit(0))).groupBy("row").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("at", "before"))).cast("long").alias("n_hit"))
    items = hits.select("row", "words", "length").distinct().join(windows.select("item_id", "words", "length").distinct(), ["words", "length"]).groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    judged = docs_found.select("row", "doc_id", "n_words").join(covered.join(items, "row", "left"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return judged.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: By definition, without winnowing: every window of every item against every window of every document.
OP7_SQL = """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(13, len(w)) AS m, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM item WHERE len(w) > 0),
known AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM win),
spot AS (SELECT r, m, w, unnest(generate_series(1, len(w) - m + 1)) AS i FROM doc, (SELECT DISTINCT m FROM known) WHERE len(w) >= m),
hit AS (SELECT r, s.m, i, item_id FROM (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS t FROM spot) s JOIN known USING (m, t)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
