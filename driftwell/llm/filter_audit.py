"""How filters interact: what each removes in every order, with table-wide duplicates found by radix text tries.

Five filters judge every whole text; a text's failures are a mask of five bits. A to D look at the text alone. E, "equal
to the text of a smaller id anywhere in the table", is decided by tries:

* Where the texts are read, each task inserts them into a compressed trie that holds, at the end of every text, the
  smallest id that came with it. A row whose own trie has a smaller id fails for certain and needs its text no more, so
  of a group of copies, however large, one row for each task and trie goes on (a trie is emptied beyond TRIE_BYTES).
* What goes on is divided by ranges of text. A sample, weighted by size (one text for UNIT bytes on average), is sorted on
  Spark; a cut is set whenever RANGE_BYTES of text have gone by, and is the shortest prefix that tells the text there
  from the one before; what is left over in a task counts with what follows in the next. So prefixes are as long as the texts demand: short in general, longer than a passage that many
  texts begin with. Only these cuts go to the driver and to the tasks, a few bytes for RANGE_BYTES of text.
* A task takes one range after the other and inserts the whole texts into the range's trie, then walks the rows again:
  those whose text ends at a smaller id fail E.

Masks with labels are counted by part and mask, 32 counts for each. All orders and steps, and the Shapley values, are sums
over these counts.

Defined results: null texts are empty ones, and all of them are copies of each other; a null source is the empty part. A
null id is smaller than nothing: it never fails E and makes no other row fail it. Rows equal in id and text don't fail by
each other, as neither id is smaller. Very long texts are inserted whole. A document with several labels has the
greatest of each kind. An empty table gives an empty result. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import empty_if_null, read

LETTERS = "ABCDE"
#: Bytes of text in a range, those that one sampled text stands for, and those that a task's own trie holds before it is emptied.
RANGE_BYTES, UNIT, TRIE_BYTES = 8 << 20, 1 << 19, 8 << 20
#: Texts are dealt to the tasks that sort the sample by so many first characters; within a task they are sorted whole.
SORT_CHARS = 256
#: Rows that need no trie any more go to ranges below zero, so many.
DECIDED = 64
SEED = 11


class Trie:
    """A compressed trie over byte strings with the smallest id at the end of each."""

    def __init__(self) -> None:
        self.root: list = [{}, None]

    def insert(self, text: bytes, own: int | None) -> list:
        """The node where the text ends; its second item is the smallest id that has come so far."""
        node, at = self.root, 0
        while at < len(text):
            edge = node[0].get(text[at])
            if edge is None:
                end: list = [{}, None]
                node[0][text[at]] = [text[at:], end]
                node = end
                break
            label, child = edge
            if not text.startswith(label, at):
                same = common(label, text, at)
                child = [{label[same]: [label[same:], child]}, None]
                edge[:] = label[:same], child
                label = edge[0]
            node, at = child, at + len(label)
        if own is not None and (node[1] is None or own < node[1]):
            node[1] = own
        return node


def common(label: bytes, text: bytes, at: int) -> int:
    """How many first bytes of the label the text has at a place."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def failures(text: Column) -> Column:
    """The bits of A to D."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    tests = [
        F.size(words) < 200,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.char_length(text) * 2,
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)).cast("int")


def cuts_of(texts: DataFrame) -> list[bytes]:
    """Ascending prefixes that divide the column `text` into ranges of about RANGE_BYTES."""
    size = F.octet_length("text")
    sample = texts.filter(F.rand(SEED) < size / F.lit(float(UNIT))).select("text")
    spread = sample.repartitionByRange(F.substring("text", 1, SORT_CHARS)).sortWithinPartitions("text")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, gone, cut = None, 0, b""
        for b in found:
            cuts = []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                gone += max(UNIT, len(text))
                if text != before:
                    # Tasks differ in the first SORT_CHARS characters, of four bytes at most.
                    cut = text[: 4 * SORT_CHARS] if before is None else text[: common(before, text, 0) + 1]
                    if gone >= RANGE_BYTES:
                        cuts.append((cut, gone))
                        gone = 0
                before = text
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cuts], pa.binary()), pa.array([c[1] for c in cuts], pa.int64())], names=["cut", "bytes"])
        if gone:
            yield pa.RecordBatch.from_arrays([pa.array([cut], pa.binary()), pa.array([gone], pa.int64())], names=["cut", "bytes"])

    cuts, gone = [], 0
    for r in sorted(spread.mapInArrow(batches, "cut binary, bytes long").collect()):
        gone += r["bytes"]
        if gone >= RANGE_BYTES:
            cuts.append(bytes(r["cut"]))
            gone = 0
    return cuts


def locally(rows: DataFrame, cuts: list[bytes]) -> DataFrame:
    """rows(doc_id, part, failed, text) with range, and E in failed where it is certain; their text is null then."""

    def emptied(batch: list[pa.RecordBatch], ends: list[list], texts: list[bytes]) -> pa.RecordBatch:
        b = pa.Table.from_batches(batch).combine_chunks()
        ids = b.column("doc_id").to_pylist()
        certain = [own is not None and end[1] < own for own, end in zip(ids, ends)]
        failed = [bits | 16 if sure else bits for bits, sure in zip(b.column("failed").to_pylist(), certain)]
        ranges = [-1 - i % DECIDED if sure else bisect_right(cuts, text) for i, (sure, text) in enumerate(zip(certain, texts))]
        rest = pa.array([None if sure else text for sure, text in zip(certain, texts)], pa.binary())
        columns = [b.column("doc_id").combine_chunks(), b.column("part").combine_chunks(), pa.array(failed, pa.int32()), rest, pa.array(ranges, pa.int32())]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["doc_id", "part", "failed", "text", "range"])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, ends, texts, size = Trie(), [], [], [], 0
        for b in found:
            own = b.column("text").cast(pa.binary()).to_pylist()
            ends += [trie.insert(text, i) for text, i in zip(own, b.column("doc_id").to_pylist())]
            held.append(b.drop_columns(["text"]))
            texts += own
            size += sum(map(len, own))
            if size >= TRIE_BYTES:
                yield emptied(held, ends, texts)
                trie, held, ends, texts, size = Trie(), [], [], [], 0
        if held:
            yield emptied(held, ends, texts)

    return rows.select("doc_id", "part", "failed", "text").mapInArrow(batches, "doc_id long, part string, failed int, text binary, range int")


def with_duplicates(rows: DataFrame) -> DataFrame:
    """rows(doc_id, part, failed, text), E added to failed; without the text."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        trie, held, ends = Trie(), [], []

        def out(judged: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in judged], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int32()))], names=["doc_id", "part", "failed"])

        def walked() -> pa.RecordBatch:
            return out([(own, part, bits | 16 if own is not None and end[1] < own else bits) for (own, part, bits), end in zip(held, ends)])

        for b in found:
            rows_ = list(zip(*[b.column(c).to_pylist() for c in ("range", "doc_id", "part", "failed", "text")]))
            yield out([(i, part, bits) for r, i, part, bits, _ in rows_ if r < 0])
            for r, i, part, bits, text in rows_:
                if r < 0:
                    continue
                if r != at:
                    if held:
                        yield walked()
                    at, trie, held, ends = r, Trie(), [], []
                held.append((i, part, bits))
                ends.append(trie.insert(text, i))
        if held:
            yield walked()

    dealt = locally(rows, cuts_of(rows)).repartition("range").sortWithinPartitions("range")
    return dealt.select("range", "doc_id", "part", "failed", "text").mapInArrow(batches, "doc_id long, part string, failed int")


def all_steps() -> list[str]:
    """Each order's steps: the order, the step, its filter's bit and the bits of the filters before."""
    bit = {x: 1 << i for i, x in enumerate(LETTERS)}
    return [f"{''.join(p)} {i + 1} {bit[p[i]]} {sum(bit[x] for x in p[:i])}" for p in permutations(LETTERS) for i in range(5)]


def audit(masks: DataFrame) -> DataFrame:
    """The report from masks(part, failed, n, good, toxic), the counts of documents by part and mask."""
    wide = masks.groupBy("part").agg(*[F.array(*[F.coalesce(F.sum(F.when(F.col("failed") == m, F.col(c))), F.lit(0)) for m in range(32)]).alias(c) for c in ("n", "good", "toxic")])
    steps = wide.withColumn("_step", F.explode(F.array(*[F.lit(x) for x in all_steps()]))).withColumn("_step", F.split("_step", " "))
    number = lambda i: F.col("_step")[i].cast("int")
    steps = steps.select("part", "n", "good", "toxic", F.col("_step")[0].alias("filter_order"), number(1).alias("step"), number(2).alias("own"), number(3).alias("before"))
    every = F.sequence(F.lit(0), F.lit(31))

    def over(counts: str, wanted: Callable[[Column], Column]) -> Column:
        """The sum of the counts whose mask is wanted."""
        return F.aggregate(every, F.lit(0).cast("long"), lambda s, m: s + F.when(wanted(m), F.col(counts)[m]).otherwise(0))

    own, earlier = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    still = lambda m: m.bitwiseAND(earlier) == 0
    shares = F.aggregate(every, F.lit(0).cast("long"), lambda s, m: s + F.when(fails(m), F.col("n")[m] * F.element_at(F.array(*[F.lit(120 // k) for k in range(1, 6)]), F.bit_count(m))).otherwise(0))
    return steps.select(
        "part",
        "filter_order",
        "step",
        over("n", lambda m: still(m) & ~fails(m)).alias("kept"),
        over("n", lambda m: still(m) & fails(m)).alias("removed"),
        over("n", lambda m: ~still(m) & fails(m)).alias("redundant"),
        over("n", lambda m: m == own).alias("unique_fails"),
        over("good", lambda m: still(m) & fails(m)).alias("good_lost"),
        over("toxic", lambda m: still(m) & fails(m)).alias("toxic_lost"),
        shares.alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, counts) of every part, order and step."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), empty_if_null(F.col(f"`{part}`").cast("string")).alias("part"), empty_if_null(F.col(f"`{text}`")).alias("text"))
    judged = with_duplicates(rows.select("doc_id", "part", failures(F.col("text")).alias("failed"), "text"))
    marks = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    counted = judged.join(marks, "doc_id", "left").groupBy("part", "failed").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return audit(counted)


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: Equal texts by grouping.
OP11_SQL = """
WITH doc AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM doc),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > first_id THEN 16 ELSE 0 END) AS m
  FROM w LEFT JOIN marks USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(x, b)),
o AS (SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order, l1.b AS b1, l2.b AS b2, l3.b AS b3, l4.b AS b4, l5.b AS b5
  FROM l l1, l l2, l l3, l l4, l l5 WHERE (l1.b | l2.b | l3.b | l4.b | l5.b) = 31),
s AS (SELECT filter_order, 1 AS step, b1 AS own, 0 AS earlier FROM o UNION ALL SELECT filter_order, 2, b2, b1 FROM o UNION ALL SELECT filter_order, 3, b3, b1 | b2 FROM o
  UNION ALL SELECT filter_order, 4, b4, b1 | b2 | b3 FROM o UNION ALL SELECT filter_order, 5, b5, b1 | b2 | b3 | b4 FROM o),
r AS (SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN (m & earlier) = 0 AND (m & own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN (m & earlier) = 0 AND (m & own) <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN (m & earlier) <> 0 AND (m & own) <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN m = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN (m & earlier) = 0 AND (m & own) <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN (m & earlier) = 0 AND (m & own) <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
