"""Phrases that stand together more often than their parts suggest, counted by vertically partitioned suffix trees.

Texts fall into pieces at punctuation and line ends, pieces into words. A phrase is a run of 2 to MOST words of a piece.
Everything is counted per language and exactly:

* Words are counted where they are read and merged by aggregation.
* A phrase that is found `least` times has only words and shorter runs of words that are found as often. Bit maps of hashes,
  one for each length up to MOST (64 bits for each frequent run, 2^28 bits at most), tell these at the texts; longer runs
  are looked at only where the shorter ones in them are frequent. Hashes that fall together let a few rare runs through and
  lose none; what is counted later are the words themselves. Run hashes travel as byte planes of sorted differences.
* A suffix is what follows from a word on while the run from there is frequent. Equal suffixes of a task are sent once, with
  their number, all with one first word in a row.
* Vertical partitioning: a suffix belongs to the group of its first word; where over GROUP_ROWS suffixes begin with that
  word, to that of its first two words, and so on. Prefixes are dealt to groups of about GROUP_ROWS suffixes, and each
  group's subtree is built by itself, cut at depth MOST. Counts stand at the leaves; an inner node's is the sum of those below
  it. A group that holds but a part of a node (a prefix that was made longer) gives that part, and the parts are added.

Scores are integer quotients of 38-digit decimals.

Defined results: null texts are empty; null languages are `und`. Equal rows count each. Ties in rank go by count, then by
the phrase's bytes. Very long texts are read whole. An empty table gives an empty result. Further columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.llm.common import cut, empty_if_null, few, lower_ascii, pieces, read, runs, slices, text_bytes
from driftwell.llm.decontaminate import mixed, word_hashes

MOST = 5
#: Suffixes of a group.
GROUP_ROWS = 1 << 16
#: Bytes of text that are split at once, and pairs or suffixes that a task gathers before it sends them.
SLICE_BYTES, GATHERED = 1 << 20, 1 << 18
#: Runs that a part counts, about.
PART_RUNS = 1 << 21
LEAST_LOG_BITS, MOST_LOG_BITS = 16, 28
STOP = np.zeros(256, dtype=bool)
STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)


def hash_of_language(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang)


class Words:
    """The words of a batch(lang, text): where they are, their language, and whether the next one is of the same piece."""

    def __init__(self, b: pa.RecordBatch):
        data, offsets = text_bytes(b.column("text"))
        self.data = lower_ascii(data)
        stop = STOP[self.data]
        self.inside = ~(stop | BLANK[self.data])
        self.starts, self.ends, owner = runs(self.inside, offsets)
        stops = np.cumsum(stop)[self.starts]
        self.joined = np.append((owner[1:] == owner[:-1]) & (stops[1:] == stops[:-1]), False)[: len(owner)]
        langs = b.column("lang").dictionary_encode()
        self.names: list[str] = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[owner]

    def texts(self) -> pa.Array:
        return pieces(self.data, self.inside, self.starts, self.ends)

    def hashes(self) -> np.ndarray:
        own = np.array([hash_of_language(x) for x in self.names], dtype=np.uint64)
        return mixed(word_hashes(self.data, self.starts, self.ends) + own[self.lang] if len(self.starts) else np.zeros(0, np.uint64))


class Bits:
    """A bit map over the first bits of hashes."""

    def __init__(self, body: np.ndarray, log_bits: int):
        self.body, self.log_bits = body, log_bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.log_bits)
        return (self.body[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bits_of(hashes: DataFrame) -> Bits:
    """The bit map of the column `hash`, which is cut. It is made on Spark in parts of 4 KB."""
    log_bits = min(MOST_LOG_BITS, max(LEAST_LOG_BITS, int(64 * hashes.count()).bit_length()))
    at = F.shiftrightunsigned("hash", 64 - log_bits) + F.lit(1)
    parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("nth")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    body = np.zeros((1 << log_bits) // 8, dtype=np.uint8)
    for r in parts.collect():
        body[(r["nth"] - 1) * 4096 : r["nth"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return Bits(body, log_bits)


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """(lang, word, n) of the words that are found `least` times, and n of all words with a null word, for each language."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(found, most=SLICE_BYTES):
            w = Words(b)
            counts = pa.table({"lang": pa.array(w.lang, pa.int32()), "word": w.texts()}).group_by(["lang", "word"]).aggregate([([], "count_all")])
            total = np.bincount(w.lang, minlength=len(w.names))
            names = pa.array(w.names, pa.string())
            lang = pa.concat_arrays([names.take(counts.column("lang").combine_chunks()), names])
            word = pa.concat_arrays([counts.column("word").combine_chunks().cast(pa.large_string()).cast(pa.string()), pa.nulls(len(names), pa.string())])
            n = pa.concat_arrays([counts.column("count_all").combine_chunks().cast(pa.int64()), pa.array(total, pa.int64())])
            yield pa.RecordBatch.from_arrays([lang, word, n], names=["lang", "word", "n"])

    counted = texts.mapInArrow(batches, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("word").isNull() | (F.col("n") >= least))


def frequent_hashes(words: DataFrame) -> DataFrame:
    """The column `hash` of words(lang, word), as `Words` has it."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            data, offsets = text_bytes(b.column("word"))
            own = np.array([hash_of_language(x) for x in b.column("lang").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(mixed(word_hashes(data, offsets[:-1], offsets[1:]) + own).view(np.int64))], names=["hash"])

    return words.select("lang", "word").mapInArrow(batches, "hash long")


class Runs:
    """At each word of a batch: whether a run of 1, 2, ... words that begins there is frequent, as far as bit maps are given."""

    def __init__(self, w: Words, maps: list[Bits]):
        self.words = w.hashes()
        self.joined, self.hashes = w.joined, self.words
        self.known = [maps[0].has(self.words)]
        for bits in maps[1:]:
            self.longer()
            self.known.append(self.possible & bits.has(self.hashes))

    def longer(self) -> None:
        """Goes on to runs of one word more: their hashes, and which of them hold frequent runs only."""
        n, size = len(self.words), len(self.known)
        following = np.zeros(n, dtype=np.uint64)
        following[: max(n - size, 0)] = self.words[size:]
        self.hashes = mixed(self.hashes * STEP + following)
        both = np.append(self.known[-1][1:], False)[:n]
        self.possible = self.known[-1] & both & self.joined


def packed(values: np.ndarray) -> bytes:
    """Ascending 32-bit values as differences, all first bytes, then all second ones and so on."""
    return np.ascontiguousarray(np.diff(values, prepend=values[:1] * 0).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(body: bytes) -> np.ndarray:
    planes = np.frombuffer(body, dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.uint64))


def frequent_runs(texts: DataFrame, maps: list[Bits], least: int, log_parts: int) -> DataFrame:
    """The column `hash` of runs of one word more than the maps have, that are found `least` times or share a hash with others.

    A hash is cut to its first log_parts bits, which name the part that counts it, and the next 32.
    """
    shift = np.uint64(32 - log_parts)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def merged() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.flatnonzero(np.diff(values >> np.uint64(32), prepend=np.uint64(1 << 63)))
            ends = np.append(at[1:], len(values))
            low = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            columns = [pa.array((values[at] >> np.uint64(32)).astype(np.int32)), pa.array([packed(low[a:b]) for a, b in zip(at, ends)], pa.binary()), pa.array([np.ascontiguousarray(n[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a, b in zip(at, ends)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "low", "n"])

        for b in slices(found, most=SLICE_BYTES):
            runs_ = Runs(Words(b), maps)
            runs_.longer()
            held.append(runs_.hashes[runs_.possible] >> shift)
            if sum(map(len, held)) >= GATHERED:
                yield merged()
                held = []
        if sum(map(len, held)):
            yield merged()

    def counted(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: int | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def many() -> np.ndarray:
            if not held:
                return np.zeros(0, np.int64)
            values, where = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([n for _, n in held]))
            return ((values[n >= least] | np.uint64(part << 32)) << shift).view(np.int64)

        for b in found:
            out = [np.zeros(0, np.int64)]
            for own, low, n in zip(*[b.column(c).to_pylist() for c in ("part", "low", "n")]):
                if own != part:
                    out.append(many())
                    part, held = own, []
                held.append((unpacked(low), np.ascontiguousarray(np.frombuffer(n, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()))
                if sum(len(v) for v, _ in held) > 8 * GATHERED and len(held) > 1:
                    values, where = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
                    held = [(values, np.bincount(where, weights=np.concatenate([n for _, n in held])))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=["hash"])
        yield pa.RecordBatch.from_arrays([pa.array(many())], names=["hash"])

    sent = texts.mapInArrow(batches, "part int, low binary, n binary").repartition("part").sortWithinPartitions("part")
    return sent.mapInArrow(counted, "hash long")


def suffixes(texts: DataFrame, maps: list[Bits]) -> DataFrame:
    """Rows of FILED: what follows from a word on while runs are frequent, 2 to MOST words, by first word, and how often a task has it."""

    def merged(held: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(held).group_by(["lang", "suffix"]).aggregate([("n", "sum")])
        return filed_under(zip(*[t.column(c).to_pylist() for c in ("lang", "suffix", "n_sum")]), 1)

    def of(w: Words) -> pa.Table | None:
        known = Runs(w, maps).known
        link = known[1]
        first = np.flatnonzero(link)
        if not len(first):
            return None
        # Codes of the words that some suffix has; 0 is none.
        used = link.copy()
        used[1:] |= link[:-1]
        at = np.flatnonzero(used)
        coded = w.texts().take(pa.array(at)).dictionary_encode()
        code = np.zeros(len(link) + MOST, dtype=np.int32)
        code[at] = coded.indices.to_numpy(zero_copy_only=False) + 1
        columns = [code[first], code[first + 1], *(np.where(known[k][first], code[first + k], 0) for k in range(2, MOST))]
        table = pa.table({"lang": pa.array(w.lang[first], pa.int32())} | {f"c{k}": c for k, c in enumerate(columns)})
        rows = table.group_by(table.column_names).aggregate([([], "count_all")])
        own = coded.dictionary.cast(pa.large_string()).cast(pa.string())
        parts = [own.take(pc.if_else(pc.greater(c, 0), pc.subtract(c, 1), pa.scalar(None, pa.int32()))) for c in (rows.column(f"c{k}").combine_chunks() for k in range(MOST))]
        suffix = pc.binary_join_element_wise(*parts, pa.scalar(" "), null_handling="skip")
        lang = pa.array(w.names, pa.string()).take(rows.column("lang").combine_chunks())
        return pa.table({"lang": lang, "suffix": suffix, "n": rows.column("count_all").combine_chunks().cast(pa.int64())})

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in slices(found, most=SLICE_BYTES):
            own = of(Words(b))
            if own is not None:
                held.append(own)
            if sum(t.num_rows for t in held) >= GATHERED:
                yield merged(held)
                held = []
        if held:
            yield merged(held)

    return texts.mapInArrow(batches, FILED)


FILED = "lang string, prefix string, depth int, suffixes array<string>, n array<long>"


def filed_under(suffixes_: Iterable[tuple[str, str, int]], depth: int) -> pa.RecordBatch:
    """Rows of FILED from (lang, suffix, n): suffixes by their first `depth` words."""
    found: dict[tuple[str, str], tuple[list[str], list[int]]] = {}
    for lang, suffix, n in suffixes_:
        own = found.setdefault((lang, " ".join(suffix.split(" ", depth)[:depth])), ([], []))
        own[0].append(suffix)
        own[1].append(n)
    columns = [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array([depth] * len(found), pa.int32())]
    columns += [pa.array([v[0] for v in found.values()], pa.list_(pa.string())), pa.array([v[1] for v in found.values()], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "prefix", "depth", "suffixes", "n"])


def grouped(rows: DataFrame) -> DataFrame:
    """rows of FILED, which are cut, with those of long prefixes filed deeper, and the group of each prefix."""

    def deeper(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for lang, depth, own, n in zip(*[b.column(c).to_pylist() for c in ("lang", "depth", "suffixes", "n")]):
                yield filed_under(((lang, s, k) for s, k in zip(own, n)), depth + 1)

    done, key = None, ["lang", "prefix"]
    for _ in range(1, MOST):
        heavy = cut(rows.groupBy(*key).agg(F.sum(F.size("suffixes")).alias("_n")).filter(F.col("_n") > GROUP_ROWS).select(*key))
        if heavy.isEmpty():
            break
        light = rows.join(few(heavy), key, "left_anti")
        done = light if done is None else done.unionByName(light)
        rows = cut(rows.join(few(heavy), key, "left_semi").select("lang", "prefix", "depth", "suffixes", "n").mapInArrow(deeper, FILED))
    filed = rows if done is None else cut(done.unionByName(rows))
    groups = max(1, -(-2 * (filed.agg(F.sum(F.size("suffixes"))).first()[0] or 0) // GROUP_ROWS))
    return filed.withColumn("group", F.pmod(F.xxhash64(*key), F.lit(groups)))


def phrase_counts(rows: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n): phrases of 2 to MOST words that are found `least` times, from rows of FILED."""

    def read_off(tree: dict, out: list[tuple]) -> None:
        """Adds every node's count to out, if it is large enough or a part only."""

        def total(node: list, lang: str, phrase: str, depth: int) -> int:
            n = node[0] + sum(total(child, lang, f"{phrase} {word}", depth + 1) for word, child in node[1].items())
            if depth > 1 and (n >= least or node[2]):
                out.append((lang, phrase, n))
            return n

        for (lang, word), node in tree.items():
            total(node, lang, word, 1)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, {}
        for b in found:
            out: list[tuple] = []
            for group, lang, depth, own, counts in zip(*[b.column(c).to_pylist() for c in ("group", "lang", "depth", "suffixes", "n")]):
                if group != at:
                    read_off(tree, out)
                    at, tree = group, {}
                for suffix, n in zip(own, counts):
                    first, *rest = suffix.split(" ")
                    node = tree.setdefault((lang, first), [0, {}, False])
                    node[2] |= depth > 1
                    for k, word in enumerate(rest, 2):
                        node = node[1].setdefault(word, [0, {}, False])
                        node[2] |= depth > k
                    node[0] += n
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "n"])
        out = []
        read_off(tree, out)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "n"])

    dealt = grouped(rows).repartition("group").sortWithinPartitions("group")
    parts = dealt.select("group", "lang", "depth", "suffixes", "n").mapInArrow(batches, "lang string, phrase string, n long")
    return parts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases(lang, phrase, n), by the cut with the lowest score."""
    known = cut(phrases.unionByName(words.select("lang", F.col("word").alias("phrase"), "n")))
    parts = phrases.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = parts.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " "))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(totals, "lang")
    wide = cuts.withColumns({c: F.col(c).cast("decimal(19,0)") for c in ("l", "r", "n")}).withColumn("_a", (F.col("a") * 1000).cast("decimal(19,0)"))
    best = wide.withColumn("score", F.expr("(_a * n) div (l * r)")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", "a", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("l", "r", "n", "score")])


def without_inner(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """candidates whose words no longer phrase has as often."""
    w = phrases.withColumn("w", F.split("phrase", " ")).filter(F.size("w") > 2)
    spans = w.withColumn("size", F.explode(F.sequence(F.lit(2), F.size("w") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)))
    inner = spans.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("n").alias("_longer"))
    return candidates.join(inner, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * 100)).drop("_longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), empty_if_null(F.col(f"`{text}`")).alias("text"))
    counted = cut(word_counts(texts, least))
    words, totals = counted.filter("word IS NOT NULL"), counted.filter("word IS NULL").select("lang", "n")
    all_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    log_parts = min(20, max(4, (all_words // PART_RUNS).bit_length()))
    maps = [bits_of(cut(frequent_hashes(words)))]
    for _ in range(1, MOST):
        maps.append(bits_of(cut(frequent_runs(texts, maps, least, log_parts))))
    phrases = cut(phrase_counts(cut(suffixes(texts, maps)), least))
    best = without_inner(scored(phrases, words, totals), phrases)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_era_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


#: By counting every run of words.
OP12_SQL = """
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws FROM piece),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
pos AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM pos, (VALUES (1), (2), (3), (4), (5)) AS v(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS a FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, ws, unnest(generate_series(1, k - 1)) AS j, k FROM c),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, x.a AS l, y.a AS r, n, CAST((1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1:j], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[j + 1:cuts.k], ' ') JOIN total ON total.lang = cuts.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM s),
size AS (SELECT lang, phrase, a, ws, k, unnest(generate_series(2, k - 1)) AS m FROM c WHERE k > 2),
span AS (SELECT lang, a, ws, m, unnest(generate_series(1, k - m + 1)) AS i FROM size),
inner_ AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM span GROUP BY ALL),
ranked AS (SELECT b.lang, b.phrase, b.a, l, r, n, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 100 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
