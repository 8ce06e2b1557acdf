"""Secret scans with multipart credential linking.

Strong findings stand alone: assigned secrets, access identifiers of a known form, long hexadecimal strings. Weak
candidates (account names, opaque strings, endpoints) are common in clean text and are reported only when complementary
parts of one credential occur together: an interval join over positions inside a scope, the scope being a document and
the interval `reach` code points, or at any distance inside a block of consecutive lines of entries (name=value, name:
value; env files, configuration, JSON). An opaque string needs an access identifier or account near it, an account needs
an opaque, assigned or hexadecimal secret, and an endpoint needs both, linked.

Parts have to be different strings: an identity and a secret that overlap are no company.

The join is by nearest neighbour in position order (a running last and first over a window), which decides the same
"some part within reach" and makes no pairs, so a text full of candidates costs no more than its length.

The regular expressions run over every whole text inside Spark's tasks and give positions in code points; all that
follows is on spans.

Defined results: null and empty texts have no spans; equal rows are scanned one by one; a span may be both strong and
weak (then the strong one stays and the weak one is dropped if it has the same bounds); a very long text is scanned
whole, its spans being all that is kept of it; of docs only the id and the text are read, so further columns may have
any names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.llm.common import cut, empty_if_null, numbered, read, slices

# Fixed values of the base contract: patterns and least lengths.
ASSIGN = r"(?a)((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
BASE_KINDS = ("assign", "access", "hex")
#: Weak kinds come after the base kinds in the order of kinds.
WEAK_KINDS = ("account", "opaque", "endpoint")
KINDS = BASE_KINDS + WEAK_KINDS
#: What identifies, and what is to be kept secret, in a credential of several parts.
ROLES = {"identity": ("access", "account"), "secret": ("opaque", "assign", "hex")}
REACH = 200
#: Lines of entries only; a value is quoted, has no space, or opens an object.
ENTRY = r"""["']?[A-Za-z_][A-Za-z0-9_.-]*["']?[ \t]*[:=][ \t]*(?:"[^"\n]*"|'[^'\n]*'|[^\s"',;{}]+|\{)"""
BLOCK = rf"(?m)(?:^[ \t{{]*(?:export[ \t]+)?{ENTRY}(?:[ \t]*[,;][ \t]*{ENTRY})*[ \t\r,;}}]*(?:\n|\Z))+"


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of strong findings and weak candidates of one text."""
    hint = text.lower()
    out = []
    if "pass" in hint or "secret" in hint or "token" in hint or "api" in hint:
        out += [("assign", *m.span()) for m in patterns()["assign"].finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in re.finditer(ACCESS, text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [("hex", *m.span()) for m in patterns()["hex"].finditer(text)]
    if "user" in hint or "login" in hint or "account" in hint or "client" in hint:
        out += [("account", *m.span()) for m in patterns()["account"].finditer(text)]
    out += [("opaque", *m.span()) for m in patterns()["opaque"].finditer(text) if is_opaque(m[0])]
    if "://" in text or "host" in hint or "endpoint" in hint:
        out += [("endpoint", *m.span()) for m in patterns()["endpoint"].finditer(text)]
    return out


def blocks_of(text: str, starts: list[int | None]) -> list[int | None]:
    """Where the block begins that each of these positions is in; null outside of blocks."""
    found = [m.span() for m in patterns()["block"].finditer(text)]
    at = [bisect_right(found, (x, len(text) + 1)) - 1 if x is not None else -1 for x in starts]
    return [found[i][0] if i >= 0 and x < found[i][1] else None for i, x in zip(at, starts)]


def patterns() -> dict[str, re.Pattern]:
    """Compiled once per process by re's own cache."""
    return {
        "assign": re.compile(ASSIGN),
        # A maximal run of 32 and more is what "leftmost, then drop the short ones" leaves.
        "hex": re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}"),
        "account": re.compile(r"(?<![^\W_])(?i:user(?:name|_id)?|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}"),
        "opaque": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"),
        "block": re.compile(BLOCK),
        "endpoint": re.compile(r"(?:\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|(?<![^\W_])(?i:host(?:name)?|endpoint)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.:/-]{3,})"),
    }


def is_opaque(value: str) -> bool:
    """Random looking: has lower case, upper case and digits."""
    return any(c.islower() for c in value) and any(c.isupper() for c in value) and any(c.isdigit() for c in value)


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, kind, start, stop, block): a row per span or candidate, and one with kind null for every document."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(found):
            at, kinds, starts, stops, blocks = [], [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                rows = [(None, None, None), *spans_of(t)]
                at += [i] * len(rows)
                # Parts of one credential are two at least.
                blocks += blocks_of(t, [x[1] for x in rows]) if len(rows) > 2 else [None] * len(rows)
                for kind, start, stop in rows:
                    kinds.append(kind)
                    starts.append(start)
                    stops.append(stop)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row").take(take), b.column("doc_id").take(take), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(blocks, pa.int64())], names=["row", "doc_id", "kind", "start", "stop", "block"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = numbered(docs, doc_id=F.col(doc_id), text=empty_if_null(text))
    return rows.mapInArrow(batches, f"row long, doc_id {kind}, kind string, start long, stop long, block long")


def link(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Strong spans, and those weak candidates that have what they need within reach or their block, with the columns of parts.

    An identity and a secret are company for each other if they do not overlap, and an endpoint needs such a pair. Each
    span is two events, its start and its end; at a start a running maximum has the nearest end before it, and at an end
    the nearest start after it, of each role.
    """
    events = parts.select("*", F.explode(F.array(F.struct(F.col("stop").alias("at"), F.lit(0).alias("turn")), F.struct(F.col("start").alias("at"), F.lit(1).alias("turn")))).alias("_e")).select("*", "_e.at", "_e.turn").drop("_e")
    back = Window.partitionBy("row").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, -1)
    # Backwards, since a frame that ends at the partition's end is computed anew for each row.
    ahead = Window.partitionBy("row").orderBy(F.desc("at"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    block = Window.partitionBy("row", "block")
    spans = events
    for role, kinds in ROLES.items():
        own = F.col("kind").isin(*kinds)
        before = F.when((F.col("turn") == 1), F.max(F.when(own & (F.col("turn") == 0), F.col("at"))).over(back))
        after = F.when((F.col("turn") == 0), F.min(F.when(own & (F.col("turn") == 1), F.col("at"))).over(ahead))
        close = F.coalesce(F.col("start") - before <= reach, F.lit(False)) | F.coalesce(after - F.col("stop") <= reach, F.lit(False))
        together = F.col("block").isNotNull() & (F.coalesce(F.min(F.when(own, F.col("stop"))).over(block) <= F.col("start"), F.lit(False)) | F.coalesce(F.max(F.when(own, F.col("start"))).over(block) >= F.col("stop"), F.lit(False)))
        spans = spans.withColumn(f"_{role}", close | together)
    found = spans.groupBy(*parts.columns).agg(*[F.bool_or(f"_{role}").alias(f"_{role}") for role in ROLES])
    # An endpoint may contain the parts, so here an overlap counts as near.
    pair = F.col("kind").isin(*ROLES["identity"]) & F.col("_secret")
    sooner = Window.partitionBy("row").orderBy("start", "stop", "kind").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("stop"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    near = F.coalesce(F.col("start") - F.max(F.when(pair, F.col("stop"))).over(sooner) <= reach, F.lit(False)) | F.coalesce(F.min(F.when(pair, F.col("start"))).over(later) - F.col("stop") <= reach, F.lit(False))
    near = near | (F.col("block").isNotNull() & F.max(pair).over(block))
    ok = F.when(F.col("kind") == "opaque", F.col("_identity")).when(F.col("kind") == "account", F.col("_secret")).when(F.col("kind") == "endpoint", near).otherwise(F.lit(True))
    same = Window.partitionBy("row", "start", "stop")
    strong = F.col("kind").isin(*BASE_KINDS)
    return found.withColumn("_ok", ok).withColumn("_strong", F.max(strong).over(same)).filter(F.col("_ok") & (strong | ~F.col("_strong"))).select(*parts.columns)


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """(row, doc_id, spans) of every document; spans: array<struct<start, nth, kind, stop>> in order."""
    found = cut(scan(docs, doc_id, text))
    nth = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    linked = link(found.filter(F.col("kind").isNotNull()), reach)
    spans = linked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", nth.alias("nth"), "kind", "stop"))).alias("spans"))
    return found.filter(F.col("kind").isNull()).select("row", "doc_id").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,nth:int,kind:string,stop:bigint>>")))


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op1_linked_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
