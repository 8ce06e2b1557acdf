"""SimHash near-duplicates with pivot distance tables.

Each text becomes a 64-bit fingerprint: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of its 3-word
shingles. Fingerprints within `most` differing bits are linked, and a component is what links reach. Rows with equal
fingerprints are brought together first, so copies cost one entry however many there are.

Pivot tables. The references are a base fingerprint and, for each of six blocks of bits, PIVOTS more that differ from the
base within that block only. How much nearer or farther one of these is than the base depends on the block's bits
alone, so two fingerprints that agree in a block have the same coordinates there; two within 3 bits agree in at least
three whole blocks, and so have equal coordinates of three blocks under one of the 20 choices. These choices, read off
the table of distances, are the index. (Distances to random references all lie near 32 with a deviation of 4, so a grid
over them separates nothing.) Under each key, pairs whose distances to some reference differ by more than `most` are
discarded (the triangle inequality), and the survivors are verified by their exact distance.

Keys are counted by aggregation. A bucket of over PIECE fingerprints is divided by the coordinates of the rest: its other
31 bits make six blocks again, of which three have to agree. What is then in one bucket agrees in 48 bits, so it is at
most 2^16 fingerprints, read in pieces of PIECE. Of the verified links only a spanning forest of each bucket is kept,
which joins the same components and has fewer edges than fingerprints.

Texts that are alike, for the pipeline (`similar`): texts whose sets of 5-word shingles have a Jaccard similarity of 0.8
or more are linked. That is some 10 of 64 bits apart, too far for keys of whole blocks, so pairs meet under keys of two
least shingle hashes each; fingerprints, their pivot distances and the sizes of the sets discard, and the sets themselves
verify. Of 8 keys of two, a pair at just 0.8 misses all with a chance of 0.0003.

Components: every node repeatedly takes the smallest label among its neighbours' labels and jumps to its label's label.

Defined results: null, empty and all-space texts have fingerprint zero (and, for `similar`, the set of one empty
shingle) and are linked like any other; equal rows are in one component; a component's id is the smallest doc_id in it
(null only if all are null); a very long text is hashed whole, in stretches; of docs only the named columns are read, so
further columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import SPACE, cut, empty_if_null, few, lower_ascii, numbered, read, runs, slices, text_bytes
from driftwell.llm.decontaminate import mixed, run_hashes, word_hashes

#: First bit and width of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
CHOICES = tuple(combinations(range(6), 3))
#: Fingerprints of one bucket that are compared at a time; longer buckets are divided into pieces of this many.
PIECE = 4096
PIVOT_SEED, PIVOTS = 20, 8
#: Keys of two least hashes for `similar`.
BANDS = 8
FULL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def references() -> tuple[int, list[list[int]]]:
    """The base, and the references of each block: random, but the same everywhere."""
    rng = np.random.default_rng(PIVOT_SEED)
    base = int(rng.integers(0, FULL, dtype=np.uint64, endpoint=True))
    return base, [[base ^ (int(x) << first) for x in rng.choice(np.arange(1, 1 << width), PIVOTS, replace=False)] for first, width in BLOCKS]


def filter_references() -> np.ndarray:
    """The references that pairs are held against: the base and three of each block."""
    base, by_block = references()
    return np.array([base, *[r for block in by_block for r in block[:3]]], dtype=np.uint64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text, as a signed long."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    n = max(len(found) - shingle + 1, 1)
    body = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = (ends - [len(w) + 1 for w in found])[:n].tolist()
    stops = (ends[shingle - 1 :] - 1 if len(found) >= shingle else ends[-1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(body[a:b], 42) for a, b in zip(starts, stops)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, row: str | None = None) -> DataFrame:
    """(row, doc_id, fp) of every row; row is its number, by `numbered`."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            values = [fingerprint(x, shingle) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(values, pa.int64())], names=["row", "doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = numbered(docs, row, doc_id=F.col(doc_id), text=empty_if_null(text))
    return rows.mapInArrow(batches, f"row long, doc_id {kind}, fp long")


def pivot_table(fps: DataFrame) -> DataFrame:
    """fps with _near: for each block, its references' distances less the base's, as one number."""
    base, by_block = references()
    distance = lambda r: F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(r))))
    with_base = fps.withColumn("_base", distance(base))
    codes = []
    for block in by_block:
        code = F.lit(0).cast("long")
        for r in block:
            code = code * F.lit(32) + (distance(r) - F.col("_base") + F.lit(16))
        codes.append(code)
    return with_base.withColumn("_near", F.array(*codes)).drop("_base")


def bucket_keys(fps: DataFrame) -> DataFrame:
    """(fp, choice, key): each fingerprint under its 20 choices of three blocks of pivot coordinates."""
    near = F.col("_near")
    keys = F.array(*[F.xxhash64(F.lit(i), *[near[b] for b in c]) for i, c in enumerate(CHOICES)])
    return pivot_table(fps).select("fp", F.posexplode(keys).alias("choice", "key"))


def inner_masks() -> list[int]:
    """For each choice of three blocks, the 20 choices of three sixths of the other bits."""
    out = []
    for c in CHOICES:
        bits = [first + k for b, (first, width) in enumerate(BLOCKS) if b not in c for k in range(width)]
        parts = [sum(1 << int(x) for x in part) for part in np.array_split(bits, 6)]
        out += [sum(parts[i] for i in d) for d in CHOICES]
    return out


def inner_keys(keyed: DataFrame) -> DataFrame:
    """keyed(fp, choice, key), each row under 20 keys within its own."""
    masks = F.array(*[F.lit(signed(m)) for m in inner_masks()])
    each = keyed.withColumn("_inner", F.explode(F.sequence(F.lit(0), F.lit(len(CHOICES) - 1))))
    return each.withColumn("key", F.xxhash64("key", "_inner", F.col("fp").bitwiseAND(masks[F.col("choice") * F.lit(len(CHOICES)) + F.col("_inner")]))).drop("_inner")


def buckets(keyed: DataFrame, refine: Callable[[DataFrame], DataFrame] | None, node: str) -> DataFrame:
    """The rows of keyed(key, node, ...) that share a key, with bucket (key, low, high): the pairs of pieces to compare.

    Buckets of up to PIECE rows are one pair (0, 0). Longer ones are divided by `refine`, if there is a way that keeps every
    linked pair together, and what is still longer is dealt into pieces, each row to every pair of pieces with its own. So
    the pairs that meet are those that share a key, whatever the size of their bucket.
    """
    counts = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    small = keyed.join(counts.filter(F.col("n") <= PIECE).select("key"), "key")
    small = small.withColumn("low", F.lit(0)).withColumn("high", F.lit(0))
    if counts.filter(F.col("n") > PIECE).isEmpty():
        return small
    finer = keyed.join(counts.filter(F.col("n") > PIECE).select("key"), "key")
    finer = finer if refine is None else refine(finer)
    pieces = F.ceil(F.col("n") / F.lit(PIECE)).cast("int")
    finer = finer.join(finer.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")
    finer = finer.withColumn("_piece", F.pmod(F.xxhash64(node), pieces).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    finer = finer.withColumn("low", F.least("_piece", "_other")).withColumn("high", F.greatest("_piece", "_other"))
    return small.unionByName(finer.select(*small.columns))


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Index pairs that make up a spanning forest of the links within a list of n.

    near(x, these) gives those of `these` that are linked with x. A node is compared, once, with those that nothing has
    reached yet; in a dense cluster hardly any are left after the first few nodes, so the work there is nearly linear.
    """
    left = np.arange(n)
    reached = np.zeros(n, dtype=bool)
    waiting: list[int] = []
    edges: list[tuple[int, int]] = []
    while len(left):
        if waiting:
            x = waiting.pop()
        else:
            x, left = int(left[0]), left[1:]
        found = near(x, left)
        if len(found):
            edges += [(x, y) for y in found.tolist()]
            waiting += found.tolist()
            reached[found] = True
            left = left[~reached[left]]
    return edges


def within(fp: np.ndarray, pivots: np.ndarray, most: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """near() for `forest`: pivot filter first, then the exact distance."""
    coordinates = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int16)

    def near(x: int, these: np.ndarray) -> np.ndarray:
        these = these[np.abs(coordinates[these] - coordinates[x]).max(axis=1, initial=0) <= most]
        return these[np.bitwise_count(fp[these] ^ fp[x]) <= most]

    return near


def whole_runs(found: Iterator[pa.RecordBatch], run: Sequence[str] = ("key", "low", "high")) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of whole runs of equal values in the columns `run`, which come sorted, with each run's start and length."""
    held: list[pa.RecordBatch] = []

    def bounds(b: pa.RecordBatch) -> np.ndarray:
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in run])
        return np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))

    def out(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        starts = bounds(b)
        return b, starts, np.diff(np.append(starts, b.num_rows))

    for b in found:
        if not b.num_rows:
            continue
        b = pa.concat_batches([*held, b])
        last = int(bounds(b)[-1])  # the last run may go on in the next batch
        if last:
            yield out(b.slice(0, last))
        held = [b.slice(last)]
    if held:
        yield out(held[0])


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """(a, b) edges that join exactly the fingerprints that links join. fps: distinct values in column fp."""
    pivots = filter_references()

    def small(fp: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of many short runs at once: at distance 1, 2, ... inside each run."""
        us, vs = [fp[:0]], [fp[:0]]
        coordinates = np.bitwise_count(fp.view(np.uint64)[None, :] ^ pivots[:, None]).astype(np.int8)
        run_end = np.repeat(starts + lengths, lengths)
        for k in range(1, int(lengths.max(initial=1))):
            i = np.arange(len(fp) - k)
            i = i[i + k < run_end[: len(fp) - k]]
            for own in coordinates:
                i = i[np.abs(own[i] - own[i + k]) <= most]
            i = i[np.bitwise_count(fp.view(np.uint64)[i] ^ fp.view(np.uint64)[i + k]) <= most]
            us.append(fp[i])
            vs.append(fp[i + k])
        return np.concatenate(us), np.concatenate(vs)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts, lengths in whole_runs(found):
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            short = lengths <= 32
            sizes = lengths[short]
            us, vs = small(fp[np.repeat(short, lengths)], np.cumsum(sizes) - sizes, sizes)
            for s, n in zip(starts[~short].tolist(), lengths[~short].tolist()):
                own = fp[s : s + n]
                pairs = np.array(forest(n, within(own.view(np.uint64), pivots, most)), dtype=np.int64).reshape(-1, 2)
                us, vs = np.append(us, own[pairs[:, 0]]), np.append(vs, own[pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(us), pa.array(vs)], names=["a", "b"])

    dealt = buckets(bucket_keys(fps), inner_keys, "fp").select("key", "low", "high", "fp")
    spread = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return spread.mapInArrow(batches, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge: label is the smallest node that it reaches.

    Each round gives a node the smallest label around it and then that label's own label, so long chains halve; the loop
    ends when a round changes nothing. A round's rows are those of the edges.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("step"))
        jump = labels.select(F.col("node").alias("step"), F.col("label").alias("further"))
        after = cut(own.join(jump, "step", "left").select("node", "old", F.least("step", "further").alias("label")))
        if after.filter("label < old").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 3, shingle: int = 3) -> DataFrame:
    """(row, doc_id, fp, label, component_id) of every row. Components differ in label, but not always in component_id."""
    rows = cut(fingerprints(docs, text, doc_id, shingle))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    reach = components(links(distinct.select("fp"), most))
    labelled = distinct.join(reach.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = labelled.groupBy("label").agg(F.min("smallest").alias("component_id"))
    membership = labelled.join(ids, "label").select("fp", "label", "component_id")
    return rows.join(membership, "fp").select("row", "doc_id", "fp", "label", "component_id")


SKETCH = "row long, fp long, same long, n int, least array<long>"


def sketches(rows: DataFrame, shingle: int = 5, with_sets: bool = False) -> DataFrame:
    """Of every row of rows(row, text): its fingerprint, a hash and the size of its shingle set, and 2 * BANDS least hashes.

    With sets, also set: the sorted 32-bit hashes of its shingles, each once. A text of fewer words has one shingle, all
    its words.
    """
    rng = np.random.default_rng(PIVOT_SEED + 1)
    factors = rng.integers(0, FULL, 2 * BANDS, dtype=np.uint64, endpoint=True) | np.uint64(1)

    def one(hashes: np.ndarray) -> tuple[int, int, int, list[int], bytes]:
        chosen = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
        raw = chosen.tobytes()
        if with_sets:
            return 0, 0, len(chosen), [], raw
        counts = np.zeros(64, dtype=np.int64)
        least = np.full(2 * BANDS, FULL, dtype=np.uint64)
        for at in range(0, len(hashes), 8192):
            part = hashes[at : at + 8192]
            counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            np.minimum(least, mixed(part[None, :] * factors[:, None]).min(axis=1), out=least)
        fp = int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0].astype(np.uint64).view(np.int64))
        return fp, signed(xxhash.xxh64_intdigest(raw)), len(chosen), least.view(np.int64).tolist(), b""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(found):
            data, offsets = text_bytes(b.column("text"))
            data = lower_ascii(data)
            starts, ends, owner = runs(~SPACE[data], offsets)
            word = word_hashes(data, starts, ends)
            long = run_hashes(word, shingle)
            first = np.searchsorted(owner, np.arange(len(offsets))).tolist()
            out = []
            for x, y in zip(first, first[1:]):
                out.append(one(long[x : y - shingle + 1] if y - x >= shingle else run_hashes(word[x:y], y - x)[:1] if y > x else np.zeros(1, np.uint64)))
            fp, same, n, least, raw = zip(*out)
            columns = [b.column("row")]
            columns += [pa.array(n, pa.int32()), pa.array(raw, pa.binary())] if with_sets else [pa.array(fp, pa.int64()), pa.array(same, pa.int64()), pa.array(n, pa.int32()), pa.array(least, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n", "set"] if with_sets else ["row", "fp", "same", "n", "least"])

    return rows.select("row", empty_if_null("text").alias("text")).mapInArrow(batches, "row long, n int, set binary" if with_sets else SKETCH)


def band_key(band: Column | int, least: Column) -> Column:
    band = F.lit(band) if isinstance(band, int) else band
    return F.xxhash64(band, least[2 * band], least[2 * band + 1])


def alike(sets: list[np.ndarray], sizes: np.ndarray, fp: np.ndarray, pivots: np.ndarray, similarity: float, most: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """near() for `forest`: sizes, pivots and fingerprints discard, the shingle sets decide."""
    close = within(fp, pivots, most)

    def near(x: int, these: np.ndarray) -> np.ndarray:
        these = these[(np.minimum(sizes[these], sizes[x]) >= similarity * np.maximum(sizes[these], sizes[x]))]
        if not len(these):
            return these
        these = close(x, these)
        own, out = sets[x], []
        for y in these.tolist():
            other = sets[y]
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            common = int((own[at] == other).sum())
            out.append(common >= similarity * (len(own) + len(other) - common))
        return these[np.array(out, dtype=bool)] if out else these

    return near


def similar(rows: DataFrame, shingle: int = 5, similarity: float = 0.8, most: int = 24) -> DataFrame:
    """(row, label) of every row of rows(row, text), which is cut: rows that links of `similarity` or more join share a label.

    most: bits that fingerprints may differ in to be looked at. Two texts at 0.8 are 9.7 bits apart, with a deviation of
    2.9, and short ones somewhat more. Labels are row numbers.
    """
    pivots = filter_references()
    sketched = cut(sketches(rows, shingle))
    classes = cut(sketched.groupBy("fp", "same", "n").agg(F.min("row").alias("node"), F.first("least").alias("least")))
    keyed = classes.select("node", "fp", "least", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).withColumn("key", band_key(F.col("band"), F.col("least")))

    dealt = cut(buckets(keyed, None, "node").select("key", "low", "high", "node", "fp"))
    members = cut(dealt.select(F.col("node").alias("row")).distinct())
    sets = sketches(rows.join(few(members), "row", "left_semi"), shingle, with_sets=True).withColumnRenamed("row", "node")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts, lengths in whole_runs(found):
            node, fp, sizes = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "fp", "n"))
            own = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in b.column("set")]
            us: list[int] = []
            vs: list[int] = []
            for s, n in zip(starts.tolist(), lengths.tolist()):
                if n > 1:
                    to = slice(s, s + n)
                    for x, y in forest(n, alike(own[to], sizes[to], fp[to].view(np.uint64), pivots, similarity, most)):
                        us.append(node[s + x])
                        vs.append(node[s + y])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["a", "b"])

    spread = dealt.join(sets, "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    reach = components(spread.mapInArrow(batches, "a long, b long").distinct())
    labelled = classes.join(reach, "node", "left").select("fp", "same", "n", F.coalesce("label", "node").alias("label"))
    return sketched.join(labelled, ["fp", "same", "n"]).select("row", "label")


def op5_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
