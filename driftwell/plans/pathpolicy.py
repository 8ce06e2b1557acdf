"""Queries over paths and policy logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftwell.functions import paths as P
from driftwell.operators import files as X
from driftwell.operators import ignoring as I
from driftwell.operators import reservations as V
from driftwell.plans.catalog import Views, query
from driftwell.plans.lineage import cut

RULES = [*P.DEFAULT_RULES, "*.tmp", "dir1/", "!dir1/f3.txt", "new/**/n1*", "(?i)/dir2/M?.TXT"]
NAME = "regexp_extract(path, '[^/]*$')"


@query("flt1_path_lint", """WITH p AS (SELECT path, string_split(path, '/') AS s FROM fx_names) SELECT path, CASE WHEN path = '' THEN 'empty' WHEN octet_length(encode(path)) > 4096 THEN 'too long' WHEN contains(path, chr(92)) THEN 'backslash' WHEN starts_with(path, '/') THEN 'absolute'
  WHEN s[1] IN ('.sync-root', '.syncignore') THEN 'reserved' WHEN substring(s[1], 2, 1) = ':' THEN 'drive' WHEN len(s) > 255 THEN 'too many segments' WHEN list_contains(s, '') THEN 'empty segment' WHEN list_contains(s, '.') OR list_contains(s, '..') THEN 'dot segment' ELSE 'ok' END AS verdict FROM p""")
def flt1(v):
    return v.fx_names.select("path", P.lint(F.col("path")).alias("verdict"))


@query("flt2_name_hazard", f"""SELECT path, CASE WHEN regexp_matches({NAME}, '[<>:"\\\\|?*]') THEN 'character' WHEN regexp_matches({NAME}, '[. ]$') THEN 'trailing dot or space' WHEN upper(split_part({NAME}, '.', 1)) IN ({", ".join(f"'{n}'" for n in P.DEVICE_NAMES)}) THEN 'device name' ELSE 'ok' END AS verdict FROM fx_names""")
def flt2(v):
    return v.fx_names.select("path", P.hazard(F.col("path")).alias("verdict"))


def _last_match_sql() -> str:
    return "CASE " + " ".join("WHEN regexp_matches(path, '{}') THEN {}".format(P.rule_pattern(r)[0].replace("'", "''"), n) for n, r in reversed(list(enumerate(RULES, 1)))) + " ELSE 0 END"


@query("flt4_ignore_rules", f"SELECT DISTINCT path, {_last_match_sql()} AS rule_no, {_last_match_sql()} NOT IN (0, {', '.join(str(n) for n, r in enumerate(RULES, 1) if r.startswith('!'))}) AS ignored FROM fx_inventory")
def flt4(v):
    return v.fx_inventory.select("path").distinct().select("path", P.last_match(F.col("path"), RULES).alias("rule_no"), P.ignored(F.col("path"), RULES).alias("ignored"))


#: Rule files of two kinds of roots, in the order in which they are read: file and lines.
RULE_FILES = {
    "even": [("built-in", P.DEFAULT_RULES), (".syncignore", ["# scratch", "*.tmp", "", "dir1/", "!dir1/f3.txt", "new/**/n1*"]), ("more.rules", ["(?i)/dir2/M?.TXT"])],
    "odd": [(".syncignore", ["**/f?.txt", "!dir0/f1.txt", "!dir2", "(?i)DIR2/F5.TXT", "a//b", "n3.tmp"])],
}


def _explain_sql() -> str:
    """The last rule whose regular expression matches the whole path, by root."""
    rows, n = [], 0
    for root, files in RULE_FILES.items():
        n = 0
        for file, lines in files:
            for line, text in enumerate(lines, 1):
                if text and not text.startswith("#") and "//" not in text:
                    n += 1
                    folded = text.startswith("(?i)")
                    bare = text[4:] if folded else text
                    pattern = P.rule_pattern(("!" if bare.startswith("!") else "") + ("(?i)" if folded else "") + bare.removeprefix("!"))[0].replace("'", "''")
                    rows.append(f"('{root}', {n}, '{bare}', '{file}', {line}, '{pattern}', {str(not bare.startswith('!')).lower()})")
    return f"""WITH rules AS (SELECT * FROM (VALUES {", ".join(rows)}) AS v(root, rule_no, rule, file, line, pattern, away)),
p AS (SELECT DISTINCT CASE WHEN group_id % 2 = 0 THEN 'even' ELSE 'odd' END AS root, path FROM fx_inventory),
hit AS (SELECT p.root, path, max(rule_no) AS rule_no FROM p JOIN rules r ON r.root = p.root AND regexp_matches(path, pattern) GROUP BY p.root, path)
SELECT p.root, p.path, coalesce(away, false) AS ignored, coalesce(h.rule_no, 0) AS rule_no, coalesce(rule, '') AS rule, coalesce(file, '') AS file, coalesce(line, 0) AS line FROM p LEFT JOIN hit h ON h.root = p.root AND h.path = p.path LEFT JOIN rules r ON r.root = h.root AND r.rule_no = h.rule_no"""


def rule_lines(v: Views):
    rows = [(root, n, file, line, text) for root, files in RULE_FILES.items() for n, (file, lines) in enumerate(files) for line, text in enumerate(lines, 1)]
    return v.spark.createDataFrame(rows, "root string, file_no int, file string, line int, text string")


@query("flt4_rule_explanations", _explain_sql())
def flt4_explained(v):
    """Every path of two kinds of roots with the rule that decides on it, its file and its line."""
    paths = v.fx_inventory.select(F.when(F.col("group_id") % 2 == 0, "even").otherwise("odd").alias("root"), "path", F.lit(False).alias("is_dir")).distinct()
    return I.explained(paths, I.parsed(rule_lines(v))).drop("is_dir").fillna({"rule_no": 0, "rule": "", "file": "", "line": 0})


def _redact_sql() -> tuple[str, dict[str, str]]:
    text, counts = "coalesce(text, '')", {}
    for category, pattern in P.REDACTIONS:
        quoted = pattern.replace("'", "''").replace("\\x00", "\\x{0}")
        counts[category] = (counts.get(category, "0")) + f" + len(regexp_extract_all({text}, '{quoted}'))"
        text = f"regexp_replace({text}, '{quoted}', '<{category}>', 'g')"
    return text, counts


_TEXT, _COUNTS = _redact_sql()
CATEGORIES = list(_COUNTS)
MAILS = "SELECT doc_id, coalesce(text, '') || ' bearer abcdefgh12345 /home/u' || CAST(doc_id % 7 AS VARCHAR) || '/x C:\\Users\\me 10.0.0.' || CAST(doc_id % 200 AS VARCHAR) AS text FROM documents"


def mails(v: Views):
    """Documents with a tail that has what the documents themselves lack."""
    tail = [F.lit(" bearer abcdefgh12345 /home/u"), (F.col("doc_id") % 7).cast("string"), F.lit("/x C:\\Users\\me 10.0.0."), (F.col("doc_id") % 200).cast("string")]
    return v.documents.select("doc_id", F.concat(F.coalesce("text", F.lit("")), *tail).alias("text"))


@query("flt5_redaction", f"WITH m AS ({MAILS}) SELECT doc_id, sha256({_TEXT}) AS redacted FROM m")
def flt5(v):
    return mails(v).select("doc_id", F.sha2(P.redact(F.col("text"))[0], 256).alias("redacted"))


@query("ag15_redaction_summary", f"WITH m AS ({MAILS}), c AS (SELECT {', '.join(f'CAST(sum({x}) AS BIGINT) AS c{i}' for i, x in enumerate(_COUNTS.values()))} FROM m) " + " UNION ALL ".join(f"SELECT '{k}' AS category, c{i} AS n FROM c" for i, k in enumerate(CATEGORIES)))
def ag15(v):
    counts = P.redact(F.col("text"))[1]
    sums = mails(v).agg(*[F.sum(c).alias(k) for k, c in counts.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(f"`{k}`").alias("n")) for k in counts])).alias("x")).select("x.category", "x.n")


COPY = "regexp_replace(path, '(.)(\\.[^./]*)?$', '\\1')"


@query("flt6_conflict_names", """SELECT group_id, path, 'dir' || substring(path, 4, 1) || '/' || split_part(split_part(path, '/', 2), '.', 1) || ' (conflicted copy, ' || strftime(make_timestamp(CAST(floor(us / 1000000) AS BIGINT) * 1000000), '%Y-%m-%d-%H%M%S') || ', ' || device_id || ', ' || substring(version_hash, 1, 8) || ').txt' AS name FROM fx_writes WHERE NOT deleted""")
def flt6(v):
    name = P.copy_path(F.col("path"), F.col("us") * 1000, F.col("device_id"), F.col("version_hash"))
    return v.fx_writes.filter("NOT deleted").select("group_id", "path", name.alias("name"))


@query("flt7_conflict_links", """WITH n AS (SELECT DISTINCT path, contains(path, ' (conflicted copy, ') AS is_copy, regexp_replace(path, ' \\(conflicted copy, [^/]*\\)', '') AS source FROM fx_names) SELECT n.path, n.is_copy, n.source, o.path IS NOT NULL AS original_there FROM n LEFT JOIN (SELECT DISTINCT path FROM fx_names) o ON o.path = n.source AND n.is_copy""")
def flt7(v):
    names = v.fx_names.distinct().select("path", P.is_copy(F.col("path")).alias("is_copy"), P.source_path(F.col("path")).alias("source"))
    there = v.fx_names.distinct().select(F.col("path").alias("source"), F.lit(True).alias("there"), F.lit(True).alias("is_copy"))
    return names.join(there, ["source", "is_copy"], "left").select("path", "is_copy", "source", F.coalesce("there", F.lit(False)).alias("original_there"))


@query("jn8_case_collisions", "SELECT a.path AS a, b.path AS b FROM (SELECT DISTINCT path FROM fx_names) a JOIN (SELECT DISTINCT path FROM fx_names) b ON lower(a.path) = lower(b.path) AND a.path < b.path")
def jn8(v):
    return collisions(v, F.lower("path"))


@query("jn9_normalization_collisions", "WITH n AS (SELECT DISTINCT path, nfc_normalize(path) AS key FROM fx_names) SELECT a.path AS a, b.path AS b FROM n a JOIN n b ON a.key = b.key AND a.path < b.path")
def jn9(v):
    return collisions(v, F.col("path").cast("string collate UNICODE"))


@query("jn10_case_normalization_collisions", "WITH n AS (SELECT DISTINCT path, lower(nfc_normalize(path)) AS key FROM fx_names) SELECT a.path AS a, b.path AS b FROM n a JOIN n b ON a.key = b.key AND a.path < b.path")
def jn10(v):
    return collisions(v, F.col("path").cast("string collate UNICODE_CI"))


#: Names that only full case folding brings together, or keeps apart.
FOLDED = ["Straße.txt", "STRASSE.txt", "strasse.TXT", "Stra\u00dfe\u0301", "STRASSE\u0301", "strass\u00e9", "Strase"]


@query("jn10_fold_classes", f"""WITH n AS (SELECT path FROM fx_names UNION SELECT unnest([{", ".join(f"'{x}'" for x in FOLDED)}])), k AS (SELECT path, nfc_normalize(lower(replace(nfc_normalize(path), 'ß', 'ss'))) AS key FROM n)
SELECT key, path, n FROM k JOIN (SELECT key, count(*) AS n FROM k GROUP BY key HAVING count(*) > 1) USING (key)""")
def jn10_classes(v):
    """The members of every class of names that fall together, so a class of n has n rows."""
    more = v.spark.createDataFrame([(x,) for x in FOLDED], "path string")
    keyed = cut(v.fx_names.select("path").unionByName(more).distinct().withColumn("key", P.canonical_fold(F.col("path"))))
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return keyed.join(many, "key").select("key", "path", "n")


def collisions(v: Views, key):
    """Pairs of different paths with one key. Keys that only one path has go before the join."""
    keyed = v.fx_names.distinct().select("path", key.alias("key"))
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    rows = keyed.join(many, "key", "left_semi")
    a, b = rows.select("key", F.col("path").alias("a")), rows.select("key", F.col("path").alias("b"))
    return a.join(b, "key").filter("a < b").select("a", "b")


@query("jn7_nested_links", """WITH b AS (SELECT link_id, local_path AS own, CASE WHEN link_id % 4 = 0 THEN local_path || '/sub' ELSE local_path END AS path FROM fx_links), p AS (SELECT local_path AS outer_path, count(*) AS n FROM fx_links GROUP BY local_path)
SELECT link_id AS inner_link, outer_path, n - CAST(own = outer_path AS BIGINT) AS n_outer, CASE WHEN path = outer_path THEN 'same' ELSE 'inside' END AS relation FROM b JOIN p ON path = outer_path OR starts_with(path, outer_path || '/') WHERE n > CAST(own = outer_path AS BIGINT)""")
def jn7(v):
    """Of every link, each path at or above its own where other links are, and how many. No pairs of links are made."""
    outer = v.fx_links.groupBy(F.col("local_path").alias("outer_path")).agg(F.count("*").alias("n"))
    inner = v.fx_links.select(F.col("link_id").alias("inner_link"), F.col("local_path").alias("own"), F.when(F.col("link_id") % 4 == 0, F.concat("local_path", F.lit("/sub"))).otherwise(F.col("local_path")).alias("path"))
    spread = inner.withColumn("outer_path", F.explode(P.prefixes(F.col("path"))))
    n_outer = (F.col("n") - (F.col("own") == F.col("outer_path")).cast("long")).alias("n_outer")
    return spread.join(outer, "outer_path").select("inner_link", "outer_path", n_outer, F.when(F.col("path") == F.col("outer_path"), "same").otherwise("inside").alias("relation")).filter("n_outer > 0")


RESERVED = """SELECT group_id, event_id AS reservation_id, CASE WHEN event_id % 13 = 0 THEN 'exclusive' WHEN event_id % 5 = 0 THEN 'intent' ELSE 'exact' END AS scope,
  CASE WHEN event_id % 13 = 0 AND event_id % 4 = 0 THEN substring(path, 1, 4) WHEN event_id % 97 = 0 THEN '' WHEN event_id % 5 = 0 THEN substring(path, 1, 4) WHEN event_id % 3 = 0 THEN path || '/s' || CAST(event_id % 2 AS STRING) ELSE path END AS path
FROM fx_files WHERE NOT deleted"""


@query("jn7_reservation_conflicts", f"""WITH r AS ({RESERVED}),
p AS (SELECT a.group_id, a.reservation_id, a.path = b.path AS same, b.path = '' OR starts_with(a.path, b.path || '/') AS b_above FROM r a JOIN r b ON a.group_id = b.group_id AND a.reservation_id <> b.reservation_id
  WHERE (a.scope = 'exclusive' OR b.scope = 'exclusive' OR (a.scope = 'exact' AND b.scope = 'exact'))
    AND (a.path = b.path OR (b.scope <> 'exact' AND (b.path = '' OR starts_with(a.path, b.path || '/'))) OR (a.scope <> 'exact' AND (a.path = '' OR starts_with(b.path, a.path || '/')))))
SELECT r.group_id, r.reservation_id, scope, path, count(*) FILTER (same) AS n_same, count(*) FILTER (NOT same AND b_above) AS n_above, count(*) FILTER (NOT same AND NOT b_above) AS n_below FROM r LEFT JOIN p USING (group_id, reservation_id) GROUP BY ALL""")
def jn7_reservations(v):
    """Each reservation's conflicts at, above and below its path."""
    files = v.fx_files.filter("NOT deleted")
    scope = F.expr("CASE WHEN event_id % 13 = 0 THEN 'exclusive' WHEN event_id % 5 = 0 THEN 'intent' ELSE 'exact' END")
    path = F.expr("CASE WHEN event_id % 13 = 0 AND event_id % 4 = 0 THEN substring(path, 1, 4) WHEN event_id % 97 = 0 THEN '' WHEN event_id % 5 = 0 THEN substring(path, 1, 4) WHEN event_id % 3 = 0 THEN path || '/s' || CAST(event_id % 2 AS STRING) ELSE path END")
    return V.conflicts(files.select("group_id", F.col("event_id").alias("reservation_id"), scope.alias("scope"), path.alias("path")))


@query("flt9_link_placement", "SELECT f.path, arg_max(l.group_id, row(length(l.local_path), l.group_id)) AS group_id, arg_max(substring(f.path, length(l.local_path) + 2), row(length(l.local_path), l.group_id)) AS relative FROM (SELECT DISTINCT local_path || '/a/b' || CAST(link_id % 5 AS VARCHAR) AS path FROM fx_links) f JOIN fx_links l ON NOT l.orphaned AND starts_with(f.path, l.local_path || '/') GROUP BY f.path")
def flt9(v):
    asked = v.fx_links.select(F.concat("local_path", F.lit("/a/b"), (F.col("link_id") % 5).cast("string")).alias("path")).distinct()
    spread = asked.select("path", F.explode(P.prefixes(F.col("path"))).alias("local_path"))
    hits = spread.join(v.fx_links.filter("NOT orphaned").select("local_path", "group_id"), "local_path")
    deepest = F.struct(F.length("local_path"), "group_id")
    return hits.groupBy("path").agg(F.max_by("group_id", deepest).alias("group_id"), F.max_by(F.expr("substring(path, length(local_path) + 2)"), deepest).alias("relative"))


@query("flt13_free_space", "WITH h AS (SELECT *, coalesce(override, greatest(1073741824, floor(total / 20))) AS headroom FROM fx_volumes) SELECT volume, CASE WHEN available < headroom THEN 'critical' WHEN available <= 2 * headroom THEN 'low' ELSE 'ok' END AS verdict, available - 500000000 < headroom AS would_breach FROM h")
def flt13(v):
    rows = v.fx_volumes.withColumn("headroom", F.coalesce("override", F.greatest(F.lit(1 << 30), F.floor(F.col("total") / 20))))
    a, h = F.col("available"), F.col("headroom")
    return rows.select("volume", F.when(a < h, "critical").when(a <= 2 * h, "low").otherwise("ok").alias("verdict"), (a - 500000000 < h).alias("would_breach"))


@query("ag17_folder_preflight", f"SELECT group_id, count(*) AS entries, count(*) FILTER ({_last_match_sql()} NOT IN (0, 11)) AS ignored, CAST(sum(size) AS BIGINT) AS bytes FROM fx_inventory GROUP BY group_id")
def ag17(v):
    return v.fx_inventory.groupBy("group_id").agg(F.count("*").alias("entries"), F.count_if(P.ignored(F.col("path"), RULES)).alias("ignored"), F.sum("size").alias("bytes"))


@query("src6_disk_inventory")
def src6(v):
    """The documents table's files as they lie on disk, compared by JN1 with the files that the table's scan names."""
    none = v.spark.createDataFrame([], "group_id long, path string, top string")
    disk, index = X.disk_inventory(v.spark, f"{v.sf_dir}/documents.parquet", "*.parquet"), X.table_index(v.documents)
    return disk.select("path", "size").join(X.compare_with_disk(index, disk, none, none, none), "path", "full_outer").select("path", "size", "status")


# Policy logs.


@query("src8_policy_log", "SELECT group_id, seq, action, device_id, epoch FROM fx_policy")
def src8(v):
    return v.fx_policy.select("group_id", "seq", "action", "device_id", "epoch").orderBy("group_id", "seq")


@query("win6_policy_chain", """WITH p AS (SELECT *, CASE WHEN group_id % 13 = 0 AND seq = 3 THEN 'broken' ELSE prev_hash END AS prev FROM fx_policy), w AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY seq) AS nth, lag(record_hash) OVER (PARTITION BY group_id ORDER BY seq) AS before, sum(CASE WHEN action = 'Rotate' THEN 1 ELSE 0 END) OVER (PARTITION BY group_id ORDER BY seq) AS generation FROM p)
SELECT group_id, bool_and(nth = seq) AS gap_free, bool_and(prev IS NOT DISTINCT FROM before) AS chained, CAST(max(generation) AS BIGINT) AS generation, arg_max(record_hash, seq) AS head FROM w GROUP BY group_id""")
def win6(v):
    order = Window.partitionBy("group_id").orderBy("seq")
    rows = v.fx_policy.withColumn("prev", F.when((F.col("group_id") % 13 == 0) & (F.col("seq") == 3), "broken").otherwise(F.col("prev_hash")))
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("before", F.lag("record_hash").over(order)).withColumn("generation", F.sum(F.when(F.col("action") == "Rotate", 1).otherwise(0)).over(order))
    return rows.groupBy("group_id").agg(F.bool_and(F.col("nth") == F.col("seq")).alias("gap_free"), F.bool_and(F.col("prev").eqNullSafe(F.col("before"))).alias("chained"), F.max("generation").alias("generation"), F.max_by("record_hash", "seq").alias("head"))


@query("jn11_writer_at_sequence", """SELECT a.group_id, a.change_hash, CASE WHEN p.record_hash IS NULL OR p.record_hash <> a.head OR p.epoch <> a.auth_epoch THEN 'unknown head'
  WHEN (SELECT arg_max(w.action, w.seq) FROM fx_policy w WHERE w.group_id = a.group_id AND w.device_id = a.device_id AND w.action IN ('Grant', 'Revoke') AND w.seq <= a.auth_seq) = 'Grant' THEN 'writer' ELSE 'not a writer' END AS verdict
FROM fx_auth a LEFT JOIN fx_policy p ON p.group_id = a.group_id AND p.seq = a.auth_seq""")
def jn11(v):
    """As-of join: log records and changes in one order per (group, device), each change taking the last record before it."""
    log = v.fx_policy.filter("action IN ('Grant', 'Revoke')").select("group_id", "device_id", F.col("seq").alias("at"), F.lit(0).alias("side"), "action", F.col("fingerprint").alias("f"), F.lit(None).cast("string").alias("change_hash"))
    asked = v.fx_auth.select("group_id", "device_id", F.col("auth_seq").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("f"), "change_hash")
    order = Window.partitionBy("group_id", "device_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = log.unionByName(asked).select("group_id", "change_hash", F.last("action", ignorenulls=True).over(order).alias("last"), F.last("f", ignorenulls=True).over(order).alias("known")).filter("change_hash IS NOT NULL")
    heads = v.fx_policy.select("group_id", F.col("seq").alias("auth_seq"), "record_hash", "epoch")
    rows = v.fx_auth.join(heads, ["group_id", "auth_seq"], "left").join(last, ["group_id", "change_hash"])
    wrong = F.col("record_hash").isNull() | (F.col("record_hash") != F.col("head")) | (F.col("epoch") != F.col("auth_epoch"))
    return rows.select("group_id", "change_hash", F.when(wrong, "unknown head").when((F.col("last") == "Grant") & (F.col("known") == F.col("fingerprint")), "writer").otherwise("not a writer").alias("verdict"))


@query("win10_watermark_verdict", "WITH mark AS (SELECT group_id, max(seq) - group_id % 2 AS seq, CASE WHEN group_id % 6 = 0 THEN 'other' ELSE arg_max(record_hash, CASE WHEN seq <= 3 THEN seq END) END AS head FROM fx_policy GROUP BY group_id), snap AS (SELECT group_id, max(seq) AS seq FROM fx_policy WHERE group_id % 7 <> 0 OR seq < 2 GROUP BY group_id) SELECT m.group_id, CASE WHEN s.seq < m.seq THEN 'rollback' WHEN p.record_hash IS DISTINCT FROM m.head AND m.seq = 3 THEN 'fork' ELSE 'accept' END AS verdict FROM mark m JOIN snap s USING (group_id) LEFT JOIN fx_policy p ON p.group_id = m.group_id AND p.seq = m.seq")
def win10(v):
    p = v.fx_policy
    third = F.max_by("record_hash", F.when(F.col("seq") <= 3, F.col("seq")))
    mark = p.groupBy("group_id").agg((F.max("seq") - F.col("group_id") % 2).alias("mark"), F.when(F.col("group_id") % 6 == 0, "other").otherwise(third).alias("head"))
    snapshot = p.filter("group_id % 7 <> 0 OR seq < 2").groupBy("group_id").agg(F.max("seq").alias("seq"))
    stored = p.select("group_id", F.col("seq").alias("mark"), "record_hash")
    rows = mark.join(snapshot, "group_id").join(stored, ["group_id", "mark"], "left")
    return rows.select("group_id", F.when(F.col("seq") < F.col("mark"), "rollback").when(~F.col("record_hash").eqNullSafe(F.col("head")) & (F.col("mark") == 3), "fork").otherwise("accept").alias("verdict"))


SCORE = "sha256('rank:' || p.head || ':' || t.path || ':' || CAST(length(w.device_id) AS VARCHAR) || ':' || w.device_id)"


@query("win7_repair_writers", f"WITH p AS (SELECT group_id, arg_max(record_hash, seq) AS head FROM fx_policy GROUP BY group_id), t AS (SELECT DISTINCT group_id, path FROM fx_touches) SELECT t.group_id, t.path, w.device_id, row_number() OVER (PARTITION BY t.group_id, t.path ORDER BY {SCORE} DESC, w.device_id) AS rank FROM t JOIN p USING (group_id) JOIN fx_writers w USING (group_id)")
def win7(v):
    head = v.fx_policy.groupBy("group_id").agg(F.max_by("record_hash", "seq").alias("head"))
    rows = v.fx_touches.select("group_id", "path").distinct().join(head, "group_id").join(v.fx_writers, "group_id")
    score = F.sha2(F.concat(F.lit("rank:"), "head", F.lit(":"), "path", F.lit(":"), F.length("device_id").cast("string"), F.lit(":"), "device_id"), 256)
    order = Window.partitionBy("group_id", "path").orderBy(score.desc(), "device_id")
    return rows.select("group_id", "path", "device_id", F.row_number().over(order).cast("long").alias("rank"))


@query("ag24_reachability", "SELECT device, CASE WHEN count(mapped_port) = 0 THEN CASE WHEN bool_or(NOT punch_ok) THEN 'blocked' ELSE 'unknown' END WHEN count(DISTINCT mapped_port) > 1 THEN 'endpoint dependent' WHEN bool_or(cgnat) THEN 'cgnat' WHEN bool_or(mapped_ip = local_ip) THEN 'open' ELSE 'endpoint independent' END AS class FROM fx_nat GROUP BY device")
def ag24(v):
    none = F.when(F.bool_or(~F.col("punch_ok")), "blocked").otherwise("unknown")
    kind = F.when(F.count("mapped_port") == 0, none).when(F.countDistinct("mapped_port") > 1, "endpoint dependent").when(F.bool_or("cgnat"), "cgnat").when(F.bool_or(F.col("mapped_ip") == F.col("local_ip")), "open").otherwise("endpoint independent")
    return v.fx_nat.groupBy("device").agg(kind.alias("class"))


@query("src9_parallel_arrays", "WITH s AS (SELECT group_id, count(*) AS n FROM fx_policy GROUP BY group_id) SELECT group_id, device_id AS target, fingerprint AS lease, n AS n_targets, n AS n_leases, false AS quarantined FROM fx_policy JOIN s USING (group_id) WHERE group_id % 10 <> 3 UNION ALL SELECT group_id, NULL, NULL, n, 0, true FROM s WHERE group_id % 10 = 3")
def src9(v):
    """Membership operations with index-parallel JSON arrays: a row per pair, or one in quarantine where lengths differ."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "device_id", "fingerprint"))).alias("x")
    ops = v.fx_policy.groupBy("group_id").agg(ordered).select("group_id", F.to_json("x.device_id").alias("targets"), F.to_json("x.fingerprint").alias("leases"))
    ops = ops.withColumn("leases", F.when(F.col("group_id") % 10 == 3, F.lit("[]")).otherwise(F.col("leases")))
    parsed = ops.select("group_id", F.from_json("targets", "array<string>").alias("target"), F.from_json("leases", "array<string>").alias("lease"))
    sizes = [F.size("target").cast("long").alias("n_targets"), F.size("lease").cast("long").alias("n_leases"), (F.size("target") != F.size("lease")).alias("quarantined")]
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("lease")))
    pairs = F.explode(F.when(F.size("target") == F.size("lease"), F.arrays_zip("target", "lease")).otherwise(nothing)).alias("x")
    return parsed.select("group_id", *sizes, pairs).select("group_id", "x.target", "x.lease", "n_targets", "n_leases", "quarantined")
