"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import collocations, filter_audit, hyperplanes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, part string, failed int, n long, word string"


def same(found, wanted):
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, wanted), key=key)


def documents(rng):
    prose = lambda n: " ".join(rng.choice(["an", "the", "THE", "Re", "é", "ou", "x", "tail"]) + str(rng.choice(["", "", rng.randint(0, 99)])) for _ in range(n))
    head = prose(400)
    texts = [None, None, "", "  \n\t", "x", "#", "ÜÄ ABC", prose(9000), head, head + "#", head + " end", head[:700], head[:701]] + [head] * 6
    texts += [prose(rng.randint(1, 500)) for _ in range(40)] + [head + prose(3) for _ in range(12)]
    texts += [texts[-1]] * 5 + [texts[-7]] * 3 + ["the the the the the the. the, the\nan the an\tthe an the"] * 6
    out = [(i, t, ("en", "de", None)[i % 3], (None, "", "a", "b")[i % 4], "p", 7, 1, "w") for i, t in enumerate(texts)]
    rng.shuffle(out)
    return out + [out[5], out[5], (None, head, "en", "a", None, None, None, None), (None, None, None, None, None, None, None, None), (10_000, head, "de", "b", None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return documents(random.Random(4))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


# 11: filter audit


def audited(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    marks = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        marks[i] = [max(marks[i][0], int(quality == 1)), max(marks[i][1], int(toxic == 1))]
    judged = []
    for i, t, _, source, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {x for x, no in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t), i is not None and i > first[t])) if no}
        judged.append((source or "", fails, *(marks[i] if i is not None else (0, 0))))
    out, removed_by = [], Counter()
    for part in {j[0] for j in judged}:
        own = [j[1:] for j in judged if j[0] == part]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                there = [j for j in own if not j[0] & set(order[:k])]
                gone = [j for j in there if x in j[0]]
                removed_by[part, x] += len(gone)
                out.append([part, "".join(order), k + 1, len(there) - len(gone), len(gone), sum(x in j[0] and bool(j[0] & set(order[:k])) for j in own), sum(j[0] == {x} for j in own), sum(j[1] for j in gone), sum(j[2] for j in gone)])
    return [(*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out]


@pytest.mark.parametrize("size", [None, 3000])
def test_audit(spark, docs, rows, size, monkeypatch):
    """With small tries and ranges too, so that copies meet only in the ranges' tries."""
    if size:
        for name in ("RANGE_BYTES", "TRIE_BYTES"):
            monkeypatch.setattr(filter_audit, name, size)
        monkeypatch.setattr(filter_audit, "UNIT", 100)
        assert len(filter_audit.cuts_of(docs.select(F.coalesce("text", F.lit("")).alias("text")))) > 5
    labels = [(i, (0, 1, None)[i % 3], i % 2) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1), (4, 0, 0)]
    found = filter_audit.interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    same(found.collect(), audited(rows, labels))


def test_audit_of_nothing(spark, docs):
    assert filter_audit.interactions(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_trie_holds_the_smallest_id_of_each_text():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() for _ in range(500)]
    trie, least = filter_audit.Trie(), {}
    ids = rng.sample(range(1000), 500)
    ends = [trie.insert(t, i) for t, i in zip(texts, ids)]
    for t, i in zip(texts, ids):
        least[t] = min(i, least.get(t, i))
    assert [e[1] for e in ends] == [least[t] for t in texts]


# 12: collocations


def counted(rows, least, first):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inner = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * own[p[i:j]]}
        best = []
        for p, a in candidates.items():
            if p not in inner:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), a, own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), x[3], x[4], x[5], n[lang], -x[0]) for i, x in enumerate(sorted(best)[:first])]
    return out


@pytest.mark.parametrize("group", [None, 3])
def test_collocations(docs, rows, group, monkeypatch):
    """With groups of three suffixes too, so that prefixes are made longer up to whole suffixes."""
    if group:
        monkeypatch.setattr(collocations, "GROUP_ROWS", group)
    found = collocations.collocations(docs, least=5, first=40).collect()
    assert len(found) > 60 and max(len(r["phrase"].split()) for r in found) == 5
    same(found, counted(rows, 5, 40))


def test_collocations_of_nothing(docs):
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_bit_maps_lose_nothing(spark):
    hashes = np.random.default_rng(3).integers(0, 1 << 64, 3000, dtype=np.uint64)
    bits = collocations.bits_of(spark.createDataFrame([(int(x),) for x in hashes.view(np.int64)], "hash long"))
    assert bits.has(hashes).all() and bits.has(hashes ^ np.uint64(1 << 60)).mean() < 0.05


def test_scores_beyond_64_bits(spark):
    n, a, l, r = 9 * 10**12, 8 * 10**11, 10**12, 10**12 - 7
    phrases = spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, n long")
    words = spark.createDataFrame([("en", "x", l), ("en", "y", r)], "lang string, word string, n long")
    found = collocations.scored(phrases, words, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert found["score"] == 1000 * a * n // (l * r)


# 13: vectors


def vectors(rng):
    out, ids = [], iter(range(1000))
    for label in (1, 2, 2, None):
        for _ in range(12):
            middle = rng.standard_normal(8)
            out += [(next(ids), (middle + rng.standard_normal(8) * s).tolist(), label) for s in rng.choice([0, 0.1, 0.3, 0.5], 6)]
    out += [(next(ids), out[3][1], 1), (next(ids), [2 * x for x in out[3][1]], 1), (next(ids), out[3][1], 2), out[3], out[3]]
    odd = [None, [], [0.0] * 8, [1.0] * 7 + [None], [1.0] * 7 + [math.nan], [1.0] * 7 + [math.inf], [1.0] * 7, [2.0] * 7, [-0.0] * 7 + [1.0], [0.0] * 7 + [1.0]]
    out += [(next(ids), v, 1) for v in odd]
    return out + [(None, [5.0] * 8, 1), (None, [5.0] * 8, 1), (None, None, None), (None, out[5][1], 1)]


def linked(rows):
    ok = [v is not None and label is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    near = [[] for _ in rows]
    for a, (_, v, label) in enumerate(rows):
        for b, (_, w, other) in enumerate(rows):
            if a != b and ok[a] and ok[b] and label == other and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                near[a].append(b)
    out = []
    for a, (own, *_) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            todo += [b for b in near[todo.pop()] if not (b in seen or seen.add(b))]
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        smallest = min(ids, default=None)
        out.append((own, len(near[a]), smallest, own == smallest))
    return out


@pytest.mark.parametrize("piece", [None, 5])
def test_vectors(spark, piece, monkeypatch):
    """With buckets of a few vectors too, dealt into pieces."""
    if piece:
        for name in ("PIECE", "BUCKET", "BLOCK"):
            monkeypatch.setattr(hyperplanes, name, piece)
    rows = vectors(np.random.default_rng(9))
    table = spark.createDataFrame([(*r, 5, "k", 1) for r in rows], "vec_id long, embedding array<double>, label int, n long, key string, space long").repartition(3)
    same(hyperplanes.near_vectors(table).collect(), linked(rows))


def test_no_vectors(spark):
    assert hyperplanes.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_tables_find_pairs_at_the_threshold():
    """Pairs at exactly the threshold's angle, under the bits and tables of a large space."""
    rng, bits = np.random.default_rng(2), 10
    tables = hyperplanes.tables_for(bits, 0.93)
    a, b = rng.standard_normal((2, 20000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    normals = hyperplanes.planes(64, bits, tables)
    meet = (((a @ normals >= 0) == (b @ normals >= 0)).reshape(len(a), tables, bits).all(axis=2)).any(axis=1)
    assert meet.mean() > 0.999
