"""What a block's windows cost: how often their bytes are held at once, and that each is found at its place."""

import random
import tracemalloc

import numpy as np
import zstandard

from driftwell.llm import context_tree


def block(text, sizes, leads=None):
    leads = leads or [0] * len(sizes)
    return context_tree.Body({"body": zstandard.compress(text), "sizes": sizes, "leads": leads, "held": [i % 2 == 1 for i in range(len(sizes))], "last": [True] * len(sizes)})


def peak(work):
    tracemalloc.start()
    try:
        found = work()
        return found, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_windows_are_read_at_once():
    """A window is one read of eight bytes: beside the result no second number of each byte is held, where shifts took two more."""
    rng = np.random.default_rng(4)
    text = rng.integers(97, 102, 1 << 20, dtype=np.uint8).tobytes()
    one = block(text, [len(text)])
    windows, most = peak(one.every_window)
    assert len(windows) == len(text) and most < 12 * len(text)


def test_windows_by_definition():
    rng = random.Random(5)
    depth = context_tree.DEPTH
    for sizes, leads in (([], None), ([0], None), ([1, 0, 3, 20, 7, 2], None), ([9, 0, 8, 30], [6, 0, 3, 2])):
        text = bytes(rng.choice(b"ab\0\xff") for _ in range(sum(sizes)))
        counts, wanted, start = {}, [], 0
        for i, size in enumerate(sizes):
            own = text[start : start + size]
            start += size
            for k in range(leads[i] if leads else 0, size):
                before = (bytes(depth) + own[:k])[-depth:][::-1]
                wanted.append(int.from_bytes(before + own[k : k + 1], "big"))
                counts[wanted[-1]] = counts.get(wanted[-1], 0) + (i % 2 == 0)
        found = block(text, sizes, leads)
        assert found.every_window().tolist() == wanted
        keys, n = found.windows()
        assert dict(zip(keys.tolist(), n.tolist())) == counts and keys.tolist() == sorted(counts)
        assert keys[context_tree.places(keys, found.every_window())].tolist() == wanted


def test_values_of_windows_that_share_slots(monkeypatch):
    """Numbers whose hashes begin alike, more than the tables can tell apart, are found all the same; so is zero."""
    monkeypatch.setattr(context_tree, "STRETCH", 100)
    back = [pow(f, -1, 1 << 56) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
    keys = np.unique(np.array([0, *(x * b % (1 << 56) for b in back for x in range(1, 700))], dtype=np.uint64))
    values = np.random.default_rng(6).integers(0, 1 << 24, len(keys)).astype(np.uint64)
    at = np.random.default_rng(7).integers(0, len(keys), 5000)
    wanted = keys[at]
    context_tree.look_up(keys, values, wanted)
    assert (wanted == values[at]).all()
