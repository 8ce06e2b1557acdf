"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate and goes from every document. How many sites have it is first estimated
by a HyperLogLog sketch per line: sketches are filled where the lines are read and merged by aggregation, so a line that
a third of all documents share costs each task one sketch. Estimates far enough from the threshold decide; lines near it
(within `margin`, several standard errors) get exact distinct counts.

A line's key is two 64-bit hashes of its text without surrounding blanks. Lines of under `least_chars` characters
(closing brackets, single words) are no boilerplate by definition and stay; 0 judges every line that is not blank.

What goes from a text depends on the text alone, so lines lead back to their documents by two hashes of the text (and
a salt by site, which deals a large group of copies over many tasks): no row numbers that could change between scans.
The boilerplate lines are broadcast while there are few (their number is counted first); beyond that the join shuffles, with
the lines of each key dealt over SALTS keys.

Defined results: null text stays null with no lines; blank lines stay; null sites count for nothing; every occurrence
of a boilerplate line goes, also repeats within a document; equal rows are cleaned one by one; a very long text is one
row with many lines; an empty table gives an empty result; further columns are kept, whatever their names, except for
n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import cut, read

KEY = ["h1", "h2"]
#: Identity of a text, and of its site's share of its copies.
TEXT = ["t1", "t2", "salt"]
#: Up to so many lines of 16 bytes each are broadcast.
MOST_BROADCAST = 1 << 18
SALTS = 16


def lines_of(rows: DataFrame, least_chars: int) -> DataFrame:
    """TEXT + (site, nth, h1, h2) of every line of rows(TEXT, site, text) that is long enough to be judged."""
    split = rows.select(*TEXT, "site", F.posexplode(F.split("text", "\n", -1)).alias("nth", "line"))
    trimmed = split.withColumn("line", F.expr("trim(BOTH ' \\t\\r' FROM line)")).filter(F.char_length("line") >= max(least_chars, 1))
    return trimmed.select(*TEXT, "site", "nth", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def among(lines: DataFrame, those: DataFrame) -> DataFrame:
    """The lines whose key is in those, a table that is cut."""
    if those.count() <= MOST_BROADCAST:
        return lines.join(F.broadcast(those), KEY, "left_semi")
    dealt = those.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("_deal", F.pmod(F.xxhash64("t1"), F.lit(SALTS)).cast("int")).join(dealt, [*KEY, "_deal"], "left_semi").drop("_deal")


def widespread(lines: DataFrame, sites: int, log_k: int = 10, margin: float = 0.25) -> DataFrame:
    """(h1, h2) of the lines that stand on at least `sites` sites."""
    sketched = lines.filter(F.col("site").isNotNull()).groupBy(*KEY).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", log_k)).alias("about"))
    likely = cut(sketched.filter(F.col("about") >= sites * (1 - margin)))
    sure = likely.filter(F.col("about") >= sites * (1 + margin)).select(*KEY)
    near = cut(likely.filter(F.col("about") < sites * (1 + margin)).select(*KEY))
    exact = among(lines.filter(F.col("site").isNotNull()), near).select(*KEY, "site").distinct().groupBy(*KEY).agg(F.count("site").alias("n")).filter(F.col("n") >= sites).select(*KEY)
    return sure.unionByName(exact)


def remove_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", sites: int = 8, least_chars: int = 20) -> DataFrame:
    """docs with their text cleaned, and n_lines and n_removed."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    inner = {c: f"_in_{i}" for i, c in enumerate(kept)}
    own = F.col(f"`{text}`")
    name = F.col(f"`{site}`").cast("string")
    identity = [F.xxhash64(own).alias("t1"), F.xxhash64(F.lit("second"), own).alias("t2"), F.pmod(F.xxhash64(name), F.lit(64)).cast("int").alias("salt")]
    lines = cut(lines_of(docs.select(*identity, name.alias("site"), own.alias("text")), least_chars))
    gone = among(lines, cut(widespread(lines, sites))).groupBy(*TEXT).agg(F.collect_set("nth").alias("_gone"))
    rows = docs.select(*identity, *[F.col(f"`{c}`").alias(inner[c]) for c in kept])
    joined = rows.join(gone, TEXT, "left").withColumn("_lines", F.split(F.col(inner[text]), "\n", -1))
    rest = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    cleaned = F.when(F.col("_gone").isNull(), F.col(inner[text])).otherwise(F.array_join(F.transform(rest, lambda i: F.col("_lines")[i]), "\n"))
    n_lines = F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(F.size("_lines"))
    columns = [(cleaned if c == text else F.col(inner[c])).alias(c) for c in kept]
    return joined.select(*columns, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(F.when(F.col("_gone").isNotNull(), F.col("_gone"))), F.lit(0)).cast("long").alias("n_removed"))


def op10_distinct_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_removed", "text")


#: By exact counts.
OP10_SQL = """
WITH doc AS (SELECT row_number() OVER () AS r, * FROM documents),
split AS (SELECT r, source, string_split(text, chr(10)) AS l FROM doc WHERE text IS NOT NULL),
line AS (SELECT r, source, i, l[i] AS raw, trim(l[i], ' ' || chr(9) || chr(13)) AS t FROM (SELECT r, source, l, unnest(generate_series(1, len(l))) AS i FROM split)),
wide AS (SELECT t FROM line WHERE length(t) >= 20 GROUP BY t HAVING count(DISTINCT source) >= 8),
judged AS (SELECT r, i, raw, wide.t IS NOT NULL AS gone FROM line LEFT JOIN wide USING (t)),
clean AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, t AS text FROM doc LEFT JOIN clean USING (r)
"""
