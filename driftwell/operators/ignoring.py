"""Ignore rules of many roots as rows, matched to paths segment by segment, with the rule that decided.

A rule is a line of a root's rule files: `!` takes back in, a trailing `/` asks for a folder, an inner `/` anchors it at the
root, `**` stands for any segments, `*` and `?` for any bytes and one byte of a segment, `(?i)` folds case. A rule that
matches a path matches all below it. The last rule that matches decides.

Rules fall into tokens, one for each segment but `**`, and paths into segments. Tokens meet a root's different segments, of
which there are far fewer than paths: plain ones by equality, patterns by a regular expression on bytes. Back at the paths, a
rule is looked at only where each of its tokens has met some segment; a column expression then walks its tokens along
the path, keeping the set of places where the next one can go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULE = ["root", "rule_no"]


def parsed(lines: DataFrame) -> DataFrame:
    """(root, rule_no, rule, file, line, back, folder, fold, anchored, tokens) of lines(root, file_no, file, line, text).

    rule_no counts a root's rules in order of files and lines. Empty lines, comments and lines that are no rule are left out.
    """
    text = F.trim("text")
    fold = F.startswith(text, F.lit("(?i)"))
    rule = F.ltrim(F.when(fold, F.expr("substring(trim(text), 5)")).otherwise(text))
    rows = lines.filter((text != "") & ~F.startswith(text, F.lit("#"))).withColumn("fold", fold).withColumn("rule", rule).filter("rule <> ''")
    rows = rows.withColumn("back", F.startswith("rule", F.lit("!"))).withColumn("_body", F.trim(F.when(F.col("back"), F.expr("substring(rule, 2)")).otherwise(F.col("rule"))))
    rows = rows.withColumn("folder", F.endswith("_body", F.lit("/"))).withColumn("_body", F.regexp_replace(F.regexp_replace("_body", "/$", ""), "^/+|/+$", ""))
    rows = rows.withColumn("_tokens", F.split("_body", "/")).filter(F.forall("_tokens", lambda t: ~t.isin("", ".", "..")))
    tokens = F.when(F.col("fold"), F.transform("_tokens", F.lower)).otherwise(F.col("_tokens"))
    order = Window.partitionBy("root").orderBy("file_no", "line")
    # A single `**` walks like an anchored rule.
    anchored = (F.size("_tokens") > 1) | (F.col("_body") == "**")
    return rows.select("root", F.row_number().over(order).alias("rule_no"), "rule", "file", "line", "back", "folder", "fold", anchored.alias("anchored"), tokens.alias("tokens"))


def as_bytes(text: Column) -> Column:
    """A character for each byte of the text."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def token_pattern(token: Column) -> Column:
    """A token as a regular expression over bytes."""
    quoted = F.regexp_replace(as_bytes(token), r"([\\\[\](){}.+^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.regexp_replace(quoted, r"\*+", ".*"), F.lit("?"), F.lit(".")), F.lit("$"))


def walked(tokens: Column, places: Column, length: Column) -> Column:
    """How many segments the tokens can take from the root on: all numbers that are possible. places: of each token, its segments."""
    none = F.array().cast("array<int>")

    def step(at: Column, i: Column) -> Column:
        after = F.transform(F.filter(F.element_at(places, i), lambda p: F.array_contains(at, p - 1)), lambda p: p)
        any_ = F.when(F.size(at) == 0, none).otherwise(F.sequence(F.array_min(at), length))
        return F.when(F.element_at(tokens, i) == "**", any_).otherwise(F.coalesce(after, none))

    return F.aggregate(F.sequence(F.lit(1), F.size(tokens)), F.array(F.lit(0)), step)


def explained(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths(root, path, is_dir), which are different, with ignored, rule_no, rule, file and line of the deciding rule (null: none).

    Paths are relative; those with a `..` segment or a leading slash belong to no root and get no rule.
    """
    segments = F.filter(F.split("path", "/"), lambda s: ~s.isin("", "."))
    fine = ~F.startswith("path", F.lit("/")) & ~F.exists(F.split("path", "/"), lambda s: s == "..")
    own = paths.select("root", "path", "is_dir", F.when(fine, segments).otherwise(F.array().cast("array<string>")).alias("_segments")).withColumn("_n", F.size("_segments"))
    spread = own.select("root", "path", F.posexplode("_segments").alias("_at", "segment")).withColumn("_at", F.col("_at") + 1)
    tokens = rules.select(*RULE, "fold", F.posexplode("tokens").alias("_i", "token")).withColumn("_i", F.col("_i") + 1).filter("token <> '**'")

    kinds = tokens.select("root", "fold", "token").distinct()
    names = spread.select("root", "segment").distinct()
    folded = names.withColumn("fold", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("own", F.when(F.col("fold"), F.lower("segment")).otherwise(F.col("segment")))
    plain = ~F.col("token").rlike(r"[*?]")
    equal = folded.join(kinds.filter(plain).withColumnRenamed("token", "own"), ["root", "fold", "own"]).select("root", "segment", "fold", F.col("own").alias("token"))
    like = folded.join(kinds.filter(~plain).withColumn("_p", token_pattern(F.col("token"))), ["root", "fold"]).filter(F.expr("decode(encode(own, 'UTF-8'), 'ISO-8859-1') rlike _p")).select("root", "segment", "fold", "token")
    met = equal.unionByName(like)

    hits = spread.join(met, ["root", "segment"]).join(tokens, ["root", "fold", "token"]).select("path", *RULE, "_i", "_at")
    places = hits.groupBy("path", *RULE, "_i").agg(F.array_sort(F.collect_set("_at")).alias("_places"))
    wanted = rules.withColumn("_needs", F.size(F.filter("tokens", lambda t: t != "**")))
    # A rule without tokens but `**` matches every path; the others need each token somewhere.
    every = own.filter("_n > 0").select("root", "path").join(wanted.filter("_needs = 0").select(*RULE), "root").withColumn("_map", F.create_map().cast("map<int,array<int>>"))
    possible = places.groupBy("path", *RULE).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_places"))).alias("_map")).unionByName(every.select("path", *RULE, "_map"))
    tried = possible.join(wanted, RULE).filter(F.size("_map") == F.col("_needs")).join(own.select("root", "path", "is_dir", "_n"), ["root", "path"])
    by_token = F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda i: F.coalesce(F.col("_map")[i], F.array().cast("array<int>")))
    ends = F.when(F.col("anchored"), walked(F.col("tokens"), F.col("_by"), F.col("_n"))).otherwise(F.col("_by")[0])
    deep = lambda e: (e > 0) & (~F.col("folder") | (e < F.col("_n")) | F.col("is_dir"))
    matched = tried.withColumn("_by", by_token).filter(F.exists(ends, deep))
    last = matched.groupBy("root", "path").agg(F.max(F.struct("rule_no", "rule", "file", "line", "back")).alias("w"))
    out = paths.join(last, ["root", "path"], "left")
    return out.select(*paths.columns, F.coalesce(~F.col("w.back"), F.lit(False)).alias("ignored"), *[F.col(f"w.{c}").alias(c) for c in ("rule_no", "rule", "file", "line")])
