"""Conflicts between reservations of paths, by nested intervals in one sorted pass.

A path's key is its segments, each ended by a low character, so that what lies below a path is a stretch of keys right after
it: [key, key with the last character raised). An exact reservation takes its own key only, a subtree one the stretch.
In key order the running number of opened less closed stretches tells how many subtree reservations lie above a place, and
the running number of keys between a stretch's ends how many lie below. Each scope has its counters; no pairs are made.

Matrix: an exclusive subtree conflicts with everything in it and with subtrees around it; exact reservations conflict at the
same path; intents conflict with exclusive ones only. Paths hold no characters below a blank (see the path lint).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ends a segment, and ends a stretch.
LOW, NEXT = "\u0001", "\u0002"
SCOPES = ("exact", "intent", "exclusive")
#: Which scopes conflict, at the same path and where one lies in the other's subtree.
CONFLICTS = {"exact": {"exact", "exclusive"}, "intent": {"exclusive"}, "exclusive": {"exact", "intent", "exclusive"}}


def conflicts(reservations: DataFrame) -> DataFrame:
    """reservations(group_id, reservation_id, scope, path) with n_same, n_above, n_below: conflicting others by where they lie."""
    key = F.concat(F.when(F.col("path") == "", F.lit("")).otherwise(F.concat(F.replace("path", F.lit("/"), F.lit(LOW)), F.lit(LOW))))
    end = F.when(F.col("path") == "", F.lit("\U0010ffff")).otherwise(F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit(NEXT)))
    rows = reservations.select("group_id", "reservation_id", "scope", "path", key.alias("_key"), end.alias("_end"))
    marks = F.array(F.struct(F.col("_key").alias("at"), F.lit(1).alias("opens")), F.struct(F.col("_end").alias("at"), F.lit(0).alias("opens")))
    marks = F.when(F.col("scope") == "exact", F.slice(marks, 1, 1)).otherwise(marks)
    each = rows.select("group_id", "reservation_id", "scope", F.explode(marks).alias("m")).select("group_id", "reservation_id", "scope", "m.*")
    upto = Window.partitionBy("group_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = Window.partitionBy("group_id", "at")
    opened = {s: F.when((F.col("scope") == s) & (F.col("opens") == 1), 1).otherwise(0) for s in SCOPES}
    closed = {s: F.when((F.col("scope") == s) & (F.col("opens") == 0), 1).otherwise(0) for s in SCOPES}
    counts = {f"o_{s}": F.sum(opened[s]).over(upto) for s in SCOPES} | {f"c_{s}": F.sum(closed[s]).over(upto) for s in SCOPES if s != "exact"} | {f"h_{s}": F.sum(opened[s]).over(here) for s in SCOPES}
    counted = each.withColumns(counts)

    def summed(f, which: set[str]) -> Column:  # noqa: ANN001
        return sum((f(s) for s in SCOPES if s in which), F.lit(0))

    def by_scope(f) -> Column:  # noqa: ANN001
        out = F.lit(None).cast("long")
        for own in SCOPES:
            out = F.when(F.col("scope") == own, f(own)).otherwise(out)
        return out

    at_start = counted.filter("opens = 1")
    same = by_scope(lambda own: summed(lambda s: F.col(f"h_{s}"), CONFLICTS[own]) - (1 if own in CONFLICTS[own] else 0))
    above = by_scope(lambda own: summed(lambda s: F.col(f"o_{s}") - F.col(f"h_{s}") - F.col(f"c_{s}"), CONFLICTS[own] - {"exact"}))
    first = at_start.select("group_id", "reservation_id", same.cast("long").alias("n_same"), above.cast("long").alias("n_above"), *[F.col(f"o_{s}").alias(f"b_{s}") for s in SCOPES])
    last = counted.filter("opens = 0").select("group_id", "reservation_id", *[F.col(f"o_{s}").alias(f"e_{s}") for s in SCOPES])
    both = reservations.join(first, ["group_id", "reservation_id"]).join(last, ["group_id", "reservation_id"], "left")
    below = by_scope(lambda own: F.lit(0) if own == "exact" else summed(lambda s: F.col(f"e_{s}") - F.col(f"b_{s}"), CONFLICTS[own]))
    return both.select(*reservations.columns, "n_same", "n_above", below.cast("long").alias("n_below"))
