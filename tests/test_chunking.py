"""Chunks of files in splits, against the same bytes in one row."""

import random

import numpy as np
import pytest

from driftwell.operators import chunking as K
from driftwell.operators import fleet as O

SPLITS = "file string, nth long, data binary"


def cut_up(rng, body, longest):
    out, at = [], 0
    while at < len(body):
        size = rng.choice([0, 1, 10, 47, 48, 49, longest // 3, longest])
        out.append(body[at : at + size])
        at += size
    return out


@pytest.mark.parametrize("stretch,cell", [(1000, 300), (1 << 20, 1 << 20)])
def test_chunks_do_not_depend_on_splits(spark, stretch, cell):
    """Small stretches and cells, so that chunks cross them; files of text, of one byte over and over, empty and tiny ones."""
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh ijkl") for _ in range(n))
    files = {"t": text(20_000), "u": text(7_001), "same": "a" * 5_000, "tiny": "x", "empty": ""}
    blobs = spark.createDataFrame([(i, files[f]) for i, f in enumerate(files)], "doc_id long, text string")
    wanted = {(list(files)[r.doc_id], r.ord, r.size, r.hash) for r in O.content_chunks(blobs, 64, 256, 1024).collect()}
    for longest in (60, 3_000):
        rows = [(f, n, part) for f, t in files.items() for n, part in enumerate(cut_up(rng, t.encode(), longest))] + [("empty", 0, None)]
        splits = spark.createDataFrame(rng.sample(rows, len(rows)), SPLITS).repartition(3)
        found = K.stream_chunks(splits, 64, 256, 1024, stretch, cell).collect()
        assert {(r.file, r.ord, r.size, r.hash) for r in found} == wanted
    assert K.stream_chunks(spark.createDataFrame([], SPLITS)).count() == 0


def test_large_file(spark):
    """40 MB at the default sizes, in splits of 1 and of 3 MB, and what stays when bytes are put in."""
    body = np.random.default_rng(4).integers(0, 256, 40_000_003, dtype=np.uint8).tobytes()
    split = lambda b, size: spark.createDataFrame([("f", n, b[at : at + size]) for n, at in enumerate(range(0, len(b), size))], SPLITS)
    small = K.stream_chunks(split(body, 1_000_000), stretch=8 << 20).cache()
    large = K.stream_chunks(split(body, 3_000_000), stretch=8 << 20)
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in large.collect()} and small.count() >= 5
    moved = K.stream_chunks(split(body[:9_000_000] + b"more" + body[9_000_000:], 1_000_000))
    report = K.shift_report(small, moved).first()
    assert report["bytes_after"] == len(body) + 4 and report["bytes_kept"] > 0.5 * len(body)
