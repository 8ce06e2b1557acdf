"""Column functions over paths and free text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits, device names, built-in ignore rules, redaction patterns in their order.
MOST_BYTES, MOST_SEGMENTS = 4096, 255
DEVICE_NAMES = ["CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"]
DEFAULT_RULES = [".DS_Store", "._*", "Thumbs.db", "desktop.ini", "*.swp", "*~", ".Spotlight-V100", ".Trashes"]
REDACTIONS = [
    ("private-key-block", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("credentialed-url", r"[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s/:@]+:[^\s/@]+@[^\s]+"),
    ("bearer-token", r"(?i)\bbearer\s+[A-Za-z0-9\-_.=]{8,}"),
    ("wireguard-key", r"\b[A-Za-z0-9+/]{43}="),
    ("home-directory", r"(?i)[A-Za-z]:\\Users\\[^\\\s]+"),
    ("home-directory", r"(?:/Users|/home)/[^/\s]+"),
    ("email-address", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("uuid-like-id", r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"),
    ("ip-address", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b|\b[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){3,7}\b"),
    ("absolute-path", r"[A-Za-z]:\\[^\s\x00\"]+"),
    ("absolute-path", r"/(?:[^/\s\x00]+/)+[^/\s\x00]+"),
]
COPY_MARK = " (conflicted copy, "


def lint(path: Column, reserved: tuple[str, ...] = (".sync-root", ".syncignore")) -> Column:
    """The first reason why a path is not acceptable, or ok."""
    parts = F.split(path, "/", -1)
    return (
        F.when(path == "", "empty")
        .when(F.octet_length(path) > MOST_BYTES, "too long")
        .when(F.instr(path, "\0") > 0, "NUL")
        .when(F.instr(path, "\\") > 0, "backslash")
        .when(F.startswith(path, F.lit("/")), "absolute")
        .when(parts[0].isin(*reserved), "reserved")
        .when(F.substring(parts[0], 2, 1) == ":", "drive")
        .when(F.size(parts) > MOST_SEGMENTS, "too many segments")
        .when(F.array_contains(parts, ""), "empty segment")
        .when(F.arrays_overlap(parts, F.array(F.lit("."), F.lit(".."))), "dot segment")
        .otherwise("ok")
    )


def hazard(path: Column) -> Column:
    """Why the last component of a path cannot be a file name on Windows, or ok."""
    name = F.element_at(F.split(path, "/", -1), -1)
    return F.when(name.rlike(r'[<>:"\\|?*]'), "character").when(name.rlike(r"[. ]$"), "trailing dot or space").when(F.upper(F.substring_index(name, ".", 1)).isin(*DEVICE_NAMES), "device name").otherwise("ok")


def rule_pattern(rule: str) -> tuple[str, bool]:
    """A rule as a regular expression over whole paths, and whether it takes paths back in.

    An inner slash anchors the rule at the root; ** crosses slashes, * and ? do not; a hit covers everything below it; a
    trailing slash asks for something below it.
    """
    back = rule.startswith("!")
    body = rule[1:] if back else rule
    fold = body.startswith("(?i)")
    body = body[4:] if fold else body
    folder = body.endswith("/")
    body = body.strip("/") if not body.startswith("/") else body[1:].rstrip("/")
    out = ""
    for token in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|[^*?/]+|/", body):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token)
    head = "^" if "/" in body else "^(?:.*/)?"
    return ("(?i)" if fold else "") + head + out + ("/.*$" if folder else "(?:/.*)?$"), back


def last_match(path: Column, rules: list[str]) -> Column:
    """The number (from 1) of the last rule that matches, or 0."""
    verdict = F.lit(0)
    for n, rule in enumerate(rules, 1):
        verdict = F.when(path.rlike(rule_pattern(rule)[0]), F.lit(n)).otherwise(verdict)
    return verdict


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last matching rule ignores the path."""
    away = [n for n, r in enumerate(rules, 1) if not rule_pattern(r)[1]]
    return last_match(path, rules).isin(*away)


def redact(text: Column) -> tuple[Column, dict[str, Column]]:
    """The text with every finding replaced by <category>, and how many there were of each category."""
    counts: dict[str, Column] = {}
    for category, pattern in REDACTIONS:
        found = F.regexp_count(text, F.lit(pattern)).cast("long")
        counts[category] = counts[category] + found if category in counts else found
        text = F.regexp_replace(text, pattern, f"<{category}>")
    return text, counts


def split_name(path: Column) -> tuple[Column, Column, Column]:
    """Folder with its slash, stem and extension with its dot."""
    folder = F.regexp_extract(path, r"^(.*/)?", 0)
    name = F.regexp_extract(path, r"[^/]*$", 0)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
    return folder, stem, F.substring(name, F.length(stem) + 1, F.length(name))


def source_path(path: Column) -> Column:
    """The path that a conflict copy was made of; other paths as they are."""
    folder, stem, extension = split_name(path)
    at = F.instr(stem, COPY_MARK)
    return F.concat(folder, F.when(at > 0, F.substring(stem, F.lit(1), at - 1)).otherwise(stem), extension)


def is_copy(path: Column) -> Column:
    return F.instr(split_name(path)[1], COPY_MARK) > 0


def copy_path(path: Column, nanos: Column, device: Column, content_hash: Column) -> Column:
    """The name of a conflict copy: stem (conflicted copy, UTC time, device, first 8 hash digits) and extension. Idempotent."""
    folder, stem, extension = split_name(source_path(path))
    time = F.date_format(F.timestamp_seconds(F.floor(nanos / F.lit(1_000_000_000)).cast("long")), "yyyy-MM-dd-HHmmss")
    return F.concat(folder, stem, F.lit(COPY_MARK), time, F.lit(", "), device, F.lit(", "), F.substring(content_hash, 1, 8), F.lit(")"), extension)


def prefixes(path: Column) -> Column:
    """A path and all folders above it."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def canonical_fold(path: Column) -> Column:
    """The key under which a volume that minds neither case nor normal form keeps a name: NFC, full case folding, NFC.

    Full folding may lengthen a name (sharp s becomes ss). Spark has no such function, so names go through Python in Arrow
    batches; fold different names only.
    """
    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        nfc = lambda x: unicodedata.normalize("NFC", x)
        return names.map(lambda x: nfc(nfc(x).casefold()), na_action="ignore")

    return fold(path)
