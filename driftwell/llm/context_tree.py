"""Language-model scores by context-tree weighting, beside a word-unigram base score.

Model. A byte is eight binary decisions, each in its own context tree over the DEPTH bytes before it. A node's decisions
have a Krichevsky-Trofimov estimate, and a node mixes it, half and half, with what its children (one byte more of
context) say together; unfolded, the tree's root mixes the estimates of all depths with weights that follow from the
training counts. Scoring is with these counts held fixed; a context that training never saw says what its parent says.
Every context of every training text is a node, at every size of the corpus.

How it is computed. Texts are packed into blocks of about BLOCK bytes. A block has each of its windows (DEPTH bytes and
the byte after them) once, with its training count, and sends them to the task of their subtree: the tree below the
nearest ROOT bytes, or below some more where a sample of blocks says that a subtree would be large. A subtree's task
adds up its windows over all blocks and weighs it from below; only the block probabilities of subtree roots, summed per
parent, go on to the small tree above all subtrees, which the driver weighs (at most 65,793 contexts of up to two bytes,
and those few that were subdivided). With that tree broadcast, the subtrees' tasks mix downwards and send each block the
log probabilities of its windows, in the order in which it sent them, as steps of 1/4096; the block adds them up per text.

Base score. A block's words go the same way: each once, to the task of its hash, which returns their training counts.
So a word or a context has one row per block however frequent it is, and nothing that grows with the corpus is
broadcast or sent to the driver but those sums.

Defined results: null and empty texts have one token, the end, and score 0; a null id counts as empty text in the
split; with nothing to learn from, every byte has probability 1/256 and every base count is 0; equal rows are scored
one by one; a text longer than a block is divided at white space, its pieces' contexts reaching back over the cut; of
docs only the id and the text are read, so further columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import SPACE, crc_of_id, cut, empty_if_null, lower_ascii, numbered, per_text, read, slices, text_bytes, words
from driftwell.llm.decontaminate import mixed, word_hashes

FOLDS, HELD = 7, 2
DEPTH, ROOT = 6, 3
#: Bytes of text in a block, and bytes of text for each bucket of windows.
BLOCK, PER_BUCKET = 6 << 20, 8 << 20
#: Subtrees with over this share of a bucket's windows have a deeper root.
SHARE_OF_BUCKET = 4.0
#: Blocks and buckets get a task each, up to so many.
MOST_TASKS = 100_000
#: Windows that are looked up at once.
STRETCH = 1 << 16
#: Values that are looked up, steps of log10 or places, have no more bits.
VALUE_BITS = np.uint64(24)
#: One step of the returned log10 probabilities.
STEP = 1 / 4096
#: The end token, which no word can equal.
END = b"\n"
WINDOWS, WORDS, BODY = 1, 2, 0
#: The top tree: how deep, which context, which decision, and what.
UP = "depth int, context long, node int, value double"


def pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def bytewise(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bytes of 64-bit numbers, the first bytes of all, then the second ones: sorted numbers pack well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)


def from_bytes(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.view(np.uint64).ravel()


# Blocks


def pieces_of(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of a text's pieces of about `most` bytes, cut after white space."""
    start = 0
    while len(data) - start > most:
        spaces = np.flatnonzero(SPACE[data[start : start + most]])
        if len(spaces):
            end = start + int(spaces[-1]) + 1
        else:
            later = np.flatnonzero(SPACE[data[start + most :]])
            end = start + most + int(later[0]) + 1 if len(later) else len(data)
        yield start, end
        start = end
    if start < len(data) or not len(data):
        yield start, len(data)


def packed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(block, rows, ids, held, leads, sizes, last, body): blocks of lower-cased texts or pieces of texts.

    leads: bytes of context that come before each piece; last: whether a piece is the last of its text.
    """
    kind = docs.schema[doc_id].dataType

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = 0, 0
        parts: list[tuple] = []

        def block() -> pa.RecordBatch:
            rows, ids, held, leads, sizes, last, bodies = zip(*parts)
            first = rows[0] * 1024 + number % 1024  # a long text is in several blocks
            lists = [pa.array([list(x)], pa.list_(t)) for x, t in ((rows, pa.int64()), (ids, id_type), (held, pa.bool_()), (leads, pa.int32()), (sizes, pa.int64()), (last, pa.bool_()))]
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))
            return pa.RecordBatch.from_arrays([pa.array([first]), *lists, pa.array([body], pa.binary())], names=["block", "rows", "ids", "held", "leads", "sizes", "last", "body"])

        for b in slices(found):
            data, offsets = text_bytes(b.column("text"))
            data = lower_ascii(data)
            id_type = b.column("doc_id").type
            for i, (row, own, held) in enumerate(zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("held").to_pylist())):
                whole = data[offsets[i] : offsets[i + 1]]
                for start, end in pieces_of(whole, BLOCK):
                    if parts and size + end - start > BLOCK:
                        yield block()
                        number, size, parts = number + 1, 0, []
                    lead = min(start, DEPTH)
                    parts.append((row, own, held, lead, end - start + lead, end == len(whole), whole[start - lead : end].tobytes()))
                    size += end - start
        if parts:
            yield block()

    source = numbered(docs, doc_id=F.col(doc_id), text=empty_if_null(text), held=crc_of_id(doc_id, FOLDS) == HELD)
    return source.mapInArrow(batches, f"block long, rows array<long>, ids array<{kind.simpleString()}>, held array<boolean>, leads array<int>, sizes array<long>, last array<boolean>, body binary")


class Body:
    """A block's bytes, and its windows and words, each once, in a fixed order."""

    def __init__(self, row: dict):
        self.row = row
        self.data = np.frombuffer(unpack(row["body"]), dtype=np.uint8)
        self.offsets = np.append(0, np.cumsum(row["sizes"])).astype(np.int64)
        self.leads = np.array(row["leads"], dtype=np.int64)
        self.held = np.array(row["held"], dtype=bool)

    def own(self) -> np.ndarray:
        """Which bytes are the pieces' own, and not context from before the cut."""
        out = np.ones(len(self.data), dtype=bool)
        for i in np.flatnonzero(self.leads).tolist():
            out[self.offsets[i] : self.offsets[i] + self.leads[i]] = False
        return out

    def every_window(self) -> np.ndarray:
        """The window of each own byte: its nearest byte highest, the byte itself lowest."""
        padded = np.zeros(len(self.data) + DEPTH + 8, dtype=np.uint8)
        padded[DEPTH + 1 : DEPTH + 1 + len(self.data)] = self.data
        # The eight bytes from each place on, as a number, have the DEPTH ones before it where a window has them.
        out = np.ndarray((len(self.data),), "<u8", padded, strides=(1,)) & np.uint64(((1 << 8 * DEPTH) - 1) << 8)
        out |= self.data
        for k in range(DEPTH):
            at = self.offsets[:-1] + k
            out[at[at < self.offsets[1:]]] &= np.uint64(((1 << 8 * k) - 1) << 8 * (DEPTH + 1 - k) | 255)
        return out[self.own()] if self.leads.any() else out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The different windows, sorted, with their training counts."""
        # The lowest bit says whether it is for training; a window leaves room for it.
        flagged = self.every_window()
        flagged <<= np.uint64(1)
        flagged |= np.repeat(~self.held, np.diff(self.offsets) - self.leads)
        flagged.sort()
        train = np.cumsum(flagged.view(np.uint8)[::8] & 1, dtype=np.int32)
        flagged >>= np.uint64(1)
        first = starts_of(flagged)
        upto = train[np.append(first[1:], len(flagged)) - 1] if len(first) else train
        return flagged[first], np.diff(upto, prepend=np.int32(0)).astype(np.int64)

    def words(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Different words (and the end) in order of their hashes, these, the code of each token, and each token's text."""
        lengths = np.diff(self.offsets) - self.leads
        found, owner = words(self.data[self.own()] if self.leads.any() else self.data, np.append(0, np.cumsum(lengths)))
        coded = found.dictionary_encode()
        names = pa.concat_arrays([coded.dictionary, pa.array([END], pa.large_binary())])
        last = np.flatnonzero(self.row["last"])
        codes = np.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.full(len(last), len(names) - 1))
        raw, offsets = text_bytes(names.cast(pa.large_binary()).view(pa.large_string()))
        hashes = word_hashes(raw, offsets[:-1], offsets[1:])
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return names.take(pa.array(order)), hashes[order], place[codes], np.append(owner, last)


def starts_of(ordered: np.ndarray) -> np.ndarray:
    """Where each different number of an ordered array begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> None:
    """Puts the values, which are below 2^24, in place of the wanted numbers below 2^56, which keys has: by a few tables of hashes, and a search for what is left.

    An odd factor maps the numbers one to one, so a slot's number and the bits that follow it tell a key exactly; an entry has
    these bits and the value, and one read gives both. Stretches of wanted numbers keep work arrays in the processor's cache.
    """
    tables, rest = [], np.arange(len(keys))
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93):
        bits = max(16, int(2 * len(rest)).bit_length())
        spread, over, up = np.uint64(factor << 8 & (1 << 64) - 1), np.uint64(64 - bits), np.uint64(bits)
        table = np.zeros(1 << bits, dtype=np.uint64)
        own = keys[rest] * spread
        slots, entries = (own >> over).view(np.int64), own << up | values[rest]
        table[slots] = entries
        tables.append((spread, over, up, table))
        rest = rest[table[slots] != entries]
    for i in range(0, len(wanted), STRETCH):
        asked = wanted[i : i + STRETCH]
        found, open_ = np.empty_like(asked), np.arange(0)
        for t, (spread, over, up, table) in enumerate(tables):
            own = (asked[open_] if t else asked) * spread
            got = table.take((own >> over).view(np.int64))
            own <<= up
            own ^= got  # the value alone where the entry is the key's, else 2^24 or more
            found[open_ if t else slice(None)] = own
            wrong = np.flatnonzero(own >> VALUE_BITS)
            open_ = open_[wrong] if t else wrong
            if not len(open_):
                break
        found[open_] = values[np.searchsorted(keys, asked[open_])]
        wanted[i : i + STRETCH] = found


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted number stands in keys, of which there are less than 2^24."""
    out = wanted.copy()
    look_up(keys, np.arange(len(keys), dtype=np.uint64), out)
    return out.astype(np.int64)


def context(windows: np.ndarray, depth: int) -> np.ndarray:
    """The nearest `depth` bytes before each window's byte."""
    return windows >> np.uint64(8 * (DEPTH + 1 - depth)) if depth else np.zeros_like(windows)


class Cut:
    """Which subtree a window belongs to: by ROOT bytes, or one more for every set of large contexts that it is in."""

    def __init__(self, large: dict[int, list[int]]):
        self.large = {d: np.array(sorted(x), dtype=np.uint64) for d, x in large.items()}

    def roots(self, windows: np.ndarray) -> np.ndarray:
        depth = np.full(len(windows), ROOT, dtype=np.int8)
        for d in range(ROOT, DEPTH):
            if len(self.large.get(d, ())):
                depth[(depth == d) & np.isin(context(windows, d), self.large[d])] = d + 1
        return depth

    def buckets(self, windows: np.ndarray, n: int) -> np.ndarray:
        depth = self.roots(windows)
        out = np.zeros(len(windows), dtype=np.int64)
        for d in np.unique(depth).tolist():
            at = depth == d
            out[at] = (mixed(context(windows[at], d) + (np.uint64(d) << np.uint64(56))) % np.uint64(n)).astype(np.int64)
        return out


def find_cut(blocks: DataFrame, n_blocks: int, n_buckets: int) -> Cut:
    """Large subtrees, from about eight blocks. They only decide how work is divided."""
    some = max(1, n_blocks // 8)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for row in b.to_pylist():
                keys, _ = Body(row).windows()
                depth, contexts, share = [], [], []
                for d in range(ROOT, DEPTH):
                    c, n = np.unique(context(keys, d), return_counts=True)
                    often = n > len(keys) / n_buckets
                    depth += [d] * int(often.sum())
                    contexts += c[often].astype(np.int64).tolist()
                    share += (n[often] / len(keys)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(depth, pa.int32()), pa.array(contexts, pa.int64()), pa.array(share, pa.float64())], names=["depth", "context", "share"])

    sample = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(some)) == 0)
    found = sample.mapInArrow(batches, "depth int, context long, share double").groupBy("depth", "context").agg(F.max("share").alias("share")).filter(F.col("share") * n_buckets > SHARE_OF_BUCKET).collect()
    large: dict[int, list[int]] = {}
    for r in found:  # at most n_buckets / SHARE_OF_BUCKET of a depth and block
        large.setdefault(r["depth"], []).append(r["context"])
    return Cut(large)


def sent(blocks: DataFrame, cut_: Cut, n_buckets: int) -> DataFrame:
    """(kind, bucket, block, payload): a block's windows and words with their training counts, by bucket."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for row in b.to_pylist():
                body = Body(row)
                kinds, numbers, payloads = [], [], []
                keys, n = body.windows()
                buckets = cut_.buckets(keys, n_buckets)
                order = np.argsort(buckets, kind="stable")
                ends = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
                for i in np.flatnonzero(np.diff(ends)).tolist():
                    at = order[ends[i] : ends[i + 1]]
                    kinds.append(WINDOWS)
                    numbers.append(i)
                    payloads.append(pack(np.array([len(at)], np.int64), bytewise(keys[at], DEPTH + 1), bytewise(n[at].astype(np.uint64), 4)))
                names, hashes, codes, owner = body.words()
                train = np.bincount(codes[~body.held[owner]], minlength=len(names)).astype(np.int64)
                raw, offsets = text_bytes(names.view(pa.large_string()))
                for i, (x, y) in enumerate(word_ranges(hashes, n_buckets)):
                    if x < y:
                        kinds.append(WORDS)
                        numbers.append(i)
                        payloads.append(pack(np.array([y - x], np.int64), train[x:y], np.diff(offsets[x : y + 1]), raw[offsets[x] : offsets[y]]))
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(numbers, pa.int32()), pa.array(np.full(len(kinds), row["block"])), pa.array(payloads, pa.binary())], names=["kind", "bucket", "block", "payload"])

    return blocks.mapInArrow(batches, "kind int, bucket int, block long, payload binary")


def word_ranges(hashes: np.ndarray, n_buckets: int) -> list[tuple[int, int]]:
    """Which of the words, which are in order of their hashes, go to each bucket."""
    number = ((hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    ends = np.searchsorted(number, np.arange(n_buckets + 1)).tolist()
    return list(zip(ends, ends[1:]))


# Subtrees


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5, by Stirling's series after a shift of eight."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = x.copy()
    for k in range(1, 8):
        product = product * (x + k)
    return series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    small = (zeros < 64) & (ones < 64)
    out = np.empty(len(zeros))
    out[small] = SMALL_KT[zeros[small], ones[small]]
    z, o = zeros[~small].astype(float), ones[~small].astype(float)
    out[~small] = log_gamma(z + 0.5) + log_gamma(o + 0.5) - log_gamma(z + o + 1) - np.log(np.pi)
    return out


_at = np.arange(64.0)
SMALL_KT = log_gamma(_at + 0.5)[:, None] + log_gamma(_at + 0.5)[None, :] - log_gamma(_at[:, None] + _at[None, :] + 1) - np.log(np.pi)
SMALL_KT[0, 0] = 0.0
HALF = np.log(0.5)


class Level:
    """The decisions of all contexts of one depth. keys: different (context, byte) in order; n: their training counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys = keys
        #: For each of the eight decisions: the run (context and bits so far) of each key, and of each run its first key.
        self.run: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.seen: list[np.ndarray] = []
        self.kt: list[np.ndarray] = []
        upto = np.append(0, np.cumsum(n))
        for k in range(8):
            fresh = np.append(True, (keys[1:] ^ keys[:-1]) >> np.uint64(8 - k) != 0) if len(keys) else np.zeros(0, bool)
            first = np.flatnonzero(fresh)
            bit = (keys >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)
            ends = np.append(first, len(keys))
            ones = np.diff(np.append(0, np.cumsum(n * bit))[ends])
            both = np.diff(upto[ends])
            self.run.append((np.cumsum(fresh) - 1).astype(np.int32))
            self.first.append(first)
            self.kt.append(log_kt(both - ones, ones))
            self.ones.append((ones + 0.5) / (both + 1.0))
            self.seen.append(both > 0)

    def nodes(self, k: int) -> np.ndarray:
        """The number of each run's decision in a byte's tree: 1 is the first, 2 and 3 the second ones."""
        return (1 << k) | ((self.keys[self.first[k]] & np.uint64(255)) >> np.uint64(8 - k)).astype(np.int64)


class Subtrees:
    """Some windows with their training counts, and the levels of their subtrees. roots: the depth of each window's root."""

    def __init__(self, windows: np.ndarray, n: np.ndarray, roots: np.ndarray):
        self.windows = windows
        self.levels: dict[int, Level] = {DEPTH: Level(windows, n)}
        self.roots = {DEPTH: roots.astype(np.int64)}
        #: For each level below the top, which key of the level above each key has, or -1 if its own is a root.
        self.parent: dict[int, np.ndarray] = {}
        for d in range(DEPTH - 1, ROOT - 1, -1):
            below = self.levels[d + 1]
            inner = self.roots[d + 1] <= d
            keys, at = np.unique(below.keys[inner] >> np.uint64(16) << np.uint64(8) | below.keys[inner] & np.uint64(255), return_inverse=True)
            counts = np.bincount(at, weights=n[inner], minlength=len(keys)).astype(np.int64)
            self.parent[d + 1] = np.full(len(below.keys), -1)
            self.parent[d + 1][inner] = at
            self.levels[d] = Level(keys, counts)
            root = np.zeros(len(keys), dtype=np.int64)
            root[at] = self.roots[d + 1][inner]
            self.roots[d] = root
            n = counts
        #: ln of the weighted block probability of every run, and its estimate's share of it.
        self.weighted: dict[int, list[np.ndarray]] = {DEPTH: self.levels[DEPTH].kt}
        self.share: dict[int, list[np.ndarray]] = {DEPTH: [np.ones(len(x)) for x in self.levels[DEPTH].kt]}
        for d in range(DEPTH - 1, ROOT - 1, -1):
            self.weighted[d], self.share[d] = [], []
            for k in range(8):
                own, below = self.levels[d], self.levels[d + 1]
                up = self.parent[d + 1][below.first[k]]
                inner = up >= 0
                children = np.bincount(own.run[k][up[inner]], weights=self.weighted[d + 1][k][inner], minlength=len(own.first[k]))
                both = np.logaddexp(HALF + own.kt[k], HALF + children)
                self.weighted[d].append(both)
                self.share[d].append(np.exp(HALF + own.kt[k] - both))

    def up(self) -> tuple[np.ndarray, ...]:
        """(depth, context, node, value): of the runs at roots, summed for each parent."""
        out = []
        for d, level in self.levels.items():
            for k in range(8):
                at = level.first[k]
                root = (self.roots[d][at] == d) & level.seen[k]
                key = (level.keys[at][root] >> np.uint64(16)) * np.uint64(256) + level.nodes(k)[root].astype(np.uint64)
                keys, where = np.unique(key, return_inverse=True)
                values = np.bincount(where, weights=self.weighted[d][k][root], minlength=len(keys))
                out.append((np.full(len(keys), d - 1), (keys >> np.uint64(8)).astype(np.int64), (keys & np.uint64(255)).astype(np.int64), values))
        return tuple(np.concatenate(x) for x in zip(*out))

    def log10(self, top: Top) -> np.ndarray:
        """log10 of the probability of each window's byte after its context."""
        total = np.zeros(len(self.windows))
        for k in range(8):
            above: tuple[np.ndarray, ...] | None = None
            for d in range(ROOT, DEPTH + 1):
                level = self.levels[d]
                first = level.first[k]
                mix, left, ended = (np.zeros(len(first)) for _ in range(3))
                up = self.parent[d][first] if d > ROOT else np.full(len(first), -1)
                inner = up >= 0
                if above is not None:
                    runs = self.levels[d - 1].run[k][up[inner]]
                    mix[inner], left[inner], ended[inner] = (x[runs] for x in above)
                mix[~inner], left[~inner], ended[~inner] = top.state(level.keys[first[~inner]] >> np.uint64(8), d, level.nodes(k)[~inner])
                seen = level.seen[k]
                share = np.where(seen, left * self.share[d][k], 0)
                mix = np.where(seen, mix + share * level.ones[k], ended)
                left = np.where(seen, left - share, 0)
                ended = np.where(seen, mix + left * level.ones[k], ended)
                above = mix, left, ended
            one = above[2][self.levels[DEPTH].run[k]]
            bit = (self.windows >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
            total += np.log10(np.where(bit, one, 1 - one))
        return total


class Top:
    """The tree above all subtrees. counts: (depth, context, byte, n); ups: (depth, context, node, value) from below.

    Of every context and decision it has what is mixed so far, the weight left for deeper contexts, and the mix that
    holds where there is none.
    """

    def __init__(self, counts: tuple[np.ndarray, ...], ups: tuple[np.ndarray, ...]):
        depth, contexts, byte, n = counts
        self.contexts: dict[int, np.ndarray] = {}
        self.states: dict[int, np.ndarray] = {}
        deepest = int(depth.max(initial=0))
        ones, kt = {}, {}
        for d in range(deepest + 1):
            at = depth == d
            self.contexts[d], where = np.unique(contexts[at], return_inverse=True)
            tree = np.zeros((len(self.contexts[d]), 512), dtype=np.int64)
            np.add.at(tree, (where, 256 + byte[at]), n[at])
            for node in range(255, 0, -1):
                tree[:, node] = tree[:, 2 * node] + tree[:, 2 * node + 1]
            zero, one = tree[:, 2:512:2], tree[:, 3:512:2]
            ones[d] = np.concatenate([np.full((len(tree), 1), 0.5), (one + 0.5) / (zero + one + 1.0)], axis=1)
            kt[d] = np.concatenate([np.zeros((len(tree), 1)), log_kt(zero.ravel(), one.ravel()).reshape(zero.shape)], axis=1)
        below = {d: np.zeros(kt[d].shape) for d in kt}
        for d in kt:
            at = ups[0] == d
            np.add.at(below[d], (np.searchsorted(self.contexts[d], ups[1][at]), ups[2][at]), ups[3][at])
        share = {}
        for d in range(deepest, -1, -1):
            weighted = np.logaddexp(HALF + kt[d], HALF + below[d])
            share[d] = np.exp(HALF + kt[d] - weighted)
            if d:
                np.add.at(below[d - 1], np.searchsorted(self.contexts[d - 1], self.contexts[d] >> 8), weighted)
        for d in range(deepest + 1):
            if d:
                parent = np.searchsorted(self.contexts[d - 1], self.contexts[d] >> 8)
                mix, left, ended = (x.astype(float)[parent] for x in self.states[d - 1])
            else:
                mix, left, ended = np.zeros(kt[0].shape), np.ones(kt[0].shape), np.full(kt[0].shape, 0.5)
            seen = kt[d] < 0
            own = np.where(seen, left * share[d], 0)
            mix = np.where(seen, mix + own * ones[d], ended)
            left = np.where(seen, left - own, 0)
            self.states[d] = np.stack([mix, left, np.where(seen, mix + left * ones[d], ended)]).astype(np.float32)

    def state(self, contexts: np.ndarray, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
        """What holds above roots of this depth with these contexts, for these decisions."""
        mix, left, ended = np.full(len(contexts), 0.5), np.zeros(len(contexts)), np.full(len(contexts), 0.5)
        for d in range(depth):
            known = self.contexts.get(d, np.zeros(0, np.int64))
            if not len(known):
                continue
            wanted = (contexts >> np.uint64(8 * (depth - d))).astype(np.int64)
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            there = known[at] == wanted
            found = self.states[d][:, at[there], nodes[there]]
            mix[there], left[there], ended[there] = found
            mix[~there], left[~there] = ended[~there], 0
        return mix, left, ended


def merged(rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The windows of several payloads, their counts over all, and where each payload's are."""
    keys, counts = [], []
    for _, raw in rows:
        body = np.frombuffer(unpack(raw), dtype=np.uint8)
        n = int(body[:8].view(np.int64)[0])
        keys.append(from_bytes(body[8 : 8 + n * (DEPTH + 1)], n, DEPTH + 1))
        counts.append(from_bytes(body[8 + n * (DEPTH + 1) :], n, 4).astype(np.int64))
    windows, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(windows)).astype(np.int64)
    return windows, total, np.split(at, np.cumsum([len(x) for x in keys])[:-1])


def counted(rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The training counts of the different words of several payloads, and which word each payload's are."""
    parts, counts = [], []
    for _, raw in rows:
        body = unpack(raw)
        n = int(np.frombuffer(body, np.int64, 1)[0])
        counts.append(np.frombuffer(body, np.int64, n, 8))
        offsets = np.append(0, np.cumsum(np.frombuffer(body, np.int64, n, 8 + 8 * n)))
        parts.append(pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body[8 + 16 * n :])]))
    coded = pa.concat_arrays(parts).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.bincount(codes, weights=np.concatenate(counts), minlength=len(coded.dictionary)).astype(np.int64)
    return total, np.split(codes, np.cumsum([len(x) for x in parts])[:-1])


def by_bucket(found: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[int, bytes]]]]:
    """(kind, bucket, [(block, payload)]) of each bucket; rows come sorted by kind and bucket."""
    now: tuple[int, int] | None = None
    held: list[tuple[int, bytes]] = []
    for b in found:
        for kind, bucket, block, payload in zip(*(b.column(c).to_pylist() for c in ("kind", "bucket", "block", "payload"))):
            if (kind, bucket) != now:
                if now is not None:
                    yield *now, held
                now, held = (kind, bucket), []
            held.append((block, payload))
    if now is not None:
        yield *now, held


def up_rows(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x), t) for x, t in zip(columns, kinds)], names=["depth", "context", "node", "value"])


def weighed(spread: DataFrame, cut_: Cut) -> DataFrame:
    """The sums that the top tree needs: UP rows, those of counts with COUNTS added to the depth. Depth -1 has the different words of training as context 0, all as 1."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, _, rows in by_bucket(found):
            if kind == WINDOWS:
                windows, n, _ = merged(rows)
                yield up_rows(Subtrees(windows, n, cut_.roots(windows)).up())
                for depth, *columns in counts_above(windows, n, cut_):
                    yield up_rows((depth + COUNTS, *columns))
            else:
                total, _ = counted(rows)
                yield up_rows((np.array([-1, -1]), np.array([0, 1]), np.array([0, 0]), np.array([np.count_nonzero(total), total.sum()], dtype=float)))

    return spread.mapInArrow(batches, UP).groupBy("depth", "context", "node").agg(F.sum("value").alias("value"))


#: What comes from below, and counts of bytes (as node) after each context above the subtrees, are told apart by depth.
COUNTS = 100


def counts_above(keys: np.ndarray, n: np.ndarray, cut_: Cut) -> Iterator[tuple[np.ndarray, ...]]:
    keys, n = keys[n > 0], n[n > 0]
    roots = cut_.roots(keys)
    for d in range(DEPTH):
        above = roots > d
        pair, at = np.unique(context(keys[above], d) << np.uint64(8) | keys[above] & np.uint64(255), return_inverse=True)
        yield np.full(len(pair), d), (pair >> np.uint64(8)).astype(np.int64), (pair & np.uint64(255)).astype(np.int32), np.bincount(at, weights=n[above], minlength=len(pair))


def columns_of(df: DataFrame) -> tuple[np.ndarray, ...]:
    rows = df.toPandas()
    return rows["depth"].to_numpy(np.int64), rows["context"].to_numpy(np.int64), rows["node"].to_numpy(np.int64), rows["value"].to_numpy(np.float64)


def answered(spread: DataFrame, cut_: Cut, top: Top) -> DataFrame:
    """(block, kind, bucket, payload): for each payload, its windows' log10 in steps of -STEP, or its words' training counts."""
    shared = spread.sparkSession.sparkContext.broadcast(top)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, bucket, rows in by_bucket(found):
            if kind == WINDOWS:
                windows, n, places = merged(rows)
                values, width = np.round(-Subtrees(windows, n, cut_.roots(windows)).log10(shared.value) / STEP).astype(np.uint64), 3
            else:
                total, places = counted(rows)
                values, width = total.astype(np.uint64), 8
            answers = [pack(bytewise(values[at], width)) for at in places]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array(np.full(len(rows), kind), pa.int32()), pa.array(np.full(len(rows), bucket), pa.int32()), pa.array(answers, pa.binary())], names=["block", "kind", "bucket", "payload"])

    return spread.mapInArrow(batches, "block long, kind int, bucket int, payload binary")


SCORED = "n_tokens long, n_known long, logs double, n_bytes long, score double"


def scored(blocks: DataFrame, answers: DataFrame, cut_: Cut, n_blocks: int, n_buckets: int) -> DataFrame:
    """(row, doc_id, held_out, SCORED) of each piece of a text: a block's bytes and the answers to it meet in one task."""
    kind = blocks.schema["ids"].dataType.elementType

    def finish(row: dict, windows: list[np.ndarray], counts: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        body = Body(row)
        each = body.every_window()
        keys = np.sort(each)
        keys = keys[starts_of(keys)]
        steps = np.zeros(len(keys), dtype=np.uint64)
        if len(keys):
            steps[np.argsort(cut_.buckets(keys, n_buckets), kind="stable")] = np.concatenate(windows)
        look_up(keys, steps, each)
        np.cumsum(each, out=each)
        lengths = np.diff(body.offsets) - body.leads
        some = lengths > 0
        total = np.zeros(len(lengths), dtype=np.int64)
        total[some] = np.diff(each[np.cumsum(lengths)[some] - 1].astype(np.int64), prepend=0)
        _, _, codes, owner = body.words()
        c, n = np.concatenate(counts), len(lengths)
        known, each_log = c > 0, np.log10(c + 1.0)
        columns = [pa.array(row["rows"], pa.int64()), pa.array(row["ids"], id_type), pa.array(body.held)]
        columns += [pa.array(per_text(owner, n), pa.int64()), pa.array(per_text(owner[known[codes]], n), pa.int64()), pa.array(per_text(owner, n, each_log[codes])), pa.array(lengths), pa.array(total * -STEP)]
        return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "n_bytes", "score"])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        windows: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for b in found:
            id_type = b.schema.field("ids").type.value_type
            for row in b.to_pylist():
                if row["kind"] == BODY:
                    if now is not None:
                        yield finish(now, windows, counts, id_type)
                    now, windows, counts = row, [], []
                    continue
                raw = np.frombuffer(unpack(row["payload"]), dtype=np.uint8)
                width = 3 if row["kind"] == WINDOWS else 8
                values = from_bytes(raw, len(raw) // width, width)
                (windows if row["kind"] == WINDOWS else counts).append(values)
        if now is not None:
            yield finish(now, windows, counts, id_type)

    bodies = blocks.withColumn("kind", F.lit(BODY)).withColumn("bucket", F.lit(0))
    together = bodies.unionByName(answers, allowMissingColumns=True)
    return together.repartition(min(max(n_blocks, 1), MOST_TASKS), "block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(batches, f"row long, doc_id {kind.simpleString()}, held_out boolean, {SCORED}")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of docs."""
    blocks = cut(packed(docs, doc_id, text))
    n_blocks, total = blocks.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0))).first()
    n_buckets = max(8, -(-total // PER_BUCKET))
    cut_ = find_cut(blocks, n_blocks, n_buckets)
    spread = cut(sent(blocks, cut_, n_buckets).repartition(min(2 * n_buckets, MOST_TASKS), "kind", "bucket").sortWithinPartitions("kind", "bucket", "block"))
    found = columns_of(weighed(spread, cut_))
    known = {int(c): int(v) for d, c, v in zip(found[0], found[1], found[3]) if d < 0}
    v, n = known.get(0, 0), known.get(1, 0)
    depth, counts = found[0], found[0] >= COUNTS
    top = Top((depth[counts] - COUNTS, *(x[counts] for x in found[1:])), tuple(x[(depth >= 0) & ~counts] for x in found))
    parts = scored(blocks, answered(spread, cut_, top), cut_, n_blocks, n_buckets)
    sums = [F.sum(x.split()[0]).alias(x.split()[0]) for x in SCORED.split(", ")]
    joined = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums)
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes"))
    return joined.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


def op6_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
