"""Ignore rules as rows against a recursive matcher."""

import random
import re

import pytest

from driftwell.operators import ignoring as I

TEXTS = ["*.tmp", "a", "a/", "!a/b", "a/*/c", "**/b", "a/**", "**", "a/**/c", "(?i)A/B", "(?i)!B", "! c", "?", "??", "é?", "a//b", "# no", "", "!", "/a/", "/c", "a.b", "x[1]+", "..", "./a", "(?i)*.TMP/", "a/b/c/d", "**/a/**/c", "b*b"]
PATHS = ["a", "a/b", "a/b/c", "a/x/c", "b", "x/b", "A/b", "a/b/x/c", "c", "x.tmp", "X.TMP/a", "é", "éa", "ax", "a.b", "axb", "x[1]+", "x/y/a/z/c", "a/./b", "/a", "a/../b", "", "b1b", "bb", "a/b/c/d/e", "a\nb"]


def glob(token, name):
    quoted = b"".join(b".*" if t == b"*" else b"." if t == b"?" else re.escape(t) for t in re.findall(rb"\*|\?|[^*?]+", token.encode()))
    return re.fullmatch(quoted, name.encode(), re.S) is not None


def walk(tokens, names):
    if not tokens:
        return not names
    if tokens[0] == "**":
        return any(walk(tokens[1:], names[i:]) for i in range(len(names) + 1))
    return bool(names) and glob(tokens[0], names[0]) and walk(tokens[1:], names[1:])


def parse(text):
    t = text.strip()
    if not t or t.startswith("#"):
        return None
    fold = t.startswith("(?i)")
    t = t[4:].lstrip() if fold else t
    back = t.startswith("!")
    body = (t[1:] if back else t).strip()
    folder = body.endswith("/")
    body = body.removesuffix("/").strip("/")
    tokens = body.split("/")
    if not t or any(x in ("", ".", "..") for x in tokens):
        return None
    return t, back, folder, fold, [x.lower() for x in tokens] if fold else tokens


def decide(path, is_dir, rules):
    names = [x for x in path.split("/") if x not in ("", ".")]
    if path.startswith("/") or ".." in path.split("/"):
        return None
    found = None
    for rule in rules:
        _, _, folder, fold, tokens = rule[2]
        own = [n.lower() for n in names] if fold else names
        ends = range(1, len(own) + 1)
        hits = [e for e in ends if glob(tokens[0], own[e - 1])] if len(tokens) == 1 and tokens[0] != "**" else [e for e in ends if walk(tokens, own[:e])]
        if any(not folder or e < len(own) or is_dir for e in hits):
            found = rule
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_of_two_roots(spark, seed):
    rng = random.Random(seed)
    lines = [(root, n, f"f{n}", line + 1, text) for root in ("r", "s") for n in range(2) for line, text in enumerate(rng.sample(TEXTS, 14))]
    rules = {root: [(f, line, p) for r, _, f, line, t in lines if r == root and (p := parse(t))] for root in ("r", "s")}
    paths = [(root, p, d) for root in ("r", "s", "none") for p in PATHS for d in [rng.random() < 0.3]]
    found = I.explained(spark.createDataFrame(paths, "root string, path string, is_dir boolean"), I.parsed(spark.createDataFrame(lines, "root string, file_no int, file string, line int, text string")))
    got = {(r.root, r.path): (r.ignored, r.rule, r.file, r.line) for r in found.collect()}
    wanted = {}
    for root, p, d in paths:
        w = decide(p, d, rules.get(root, []))
        wanted[root, p] = (False, None, None, None) if w is None else (not w[2][1], w[2][0], w[0], w[1])
    assert got == wanted
