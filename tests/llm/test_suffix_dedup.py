"""Suffix-array deduplication: suffix arrays against sorting, removed bytes against every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillmark.llm import suffix_dedup
from quillmark.llm.gsaca import suffix_array
from tests.llm.conftest import prose


def test_suffix_array():
    r = np.random.default_rng(1)
    for _ in range(500):
        t = r.integers(0, r.integers(1, 5), r.integers(0, 60)).tolist()
        assert suffix_array(np.array(t, dtype=np.int64)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    t = ([5, 6, 7] * 400 + [5, 6] * 300) * 2
    assert suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_sliding_minimum():
    r = np.random.default_rng(2)
    for n, w in ((10, 3), (7, 7), (100, 9), (5, 1)):
        x = r.integers(0, 50, n).astype(np.uint64)
        assert suffix_dedup.sliding_minimum(x, w).tolist() == [min(x[i:i + w]) for i in range(n - w + 1)]


def brute(rows, window):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k:k + window] for _, b in data for k in range(len(b) - window + 1))
    out = []
    for i, b in data:
        cover = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - window + 1):
            if count[b[k:k + window]] > 1:
                cover[k:k + window] = True
        runs = int((np.diff(cover.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(b, dtype=np.uint8)[~cover].tobytes()
        out.append((i, len(b), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def planted():
    """Copies, edited copies, passages of every length around the window, periodic texts, repeats inside a text."""
    r = random.Random(4)
    base = prose(1, 160)
    rows = [(i, base if i < 5 else " ".join(f"y{r.randrange(10**6)}" if r.random() < 0.02 else w for w in base.split(" ")))
            for i in range(25)]
    line = prose(2, 40)
    for k in range(25):
        rows.append((100 + k, f"{prose(100 + k, 15)} {line[: 80 + 5 * k]}{prose(200 + k, 20)}"))
    rows += [(200, "ab" * 300), (201, "abc" * 90), (202, "x" * 700), (203, prose(5, 30) * 3), (204, "é中🙂" * 60)]
    return rows


@pytest.mark.parametrize("options", [dict(window=100, core=30, span=11), dict(window=100, core=60, span=16, crowd=2),
                                     dict(window=61, core=20, span=42, crowd=5, bucket_slices=20)])
def test_removed_bytes(make, awkward, options):
    rows = planted() + [r for r in awkward if len(r[1] or "") < 6000]
    got = suffix_dedup.dedup(make(rows), **options).collect()
    mine = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert mine == brute(rows, options["window"])
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_slices_grow_with_the_stretches(spark, make):
    """One passage shorter, then longer than the window in many texts: every middle is crowded."""
    line = prose(2, 40)
    for n in (88, 130):
        rows = [(k, f"{prose(1000 + k, 15)} {line[:n]} {prose(3000 + k, 20)}") for k in range(300)]
        got = suffix_dedup.dedup(make(rows), window=100, core=30, span=35, crowd=20).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 100)


def test_empty_table(make):
    assert suffix_dedup.dedup(make([(1, "a")]).limit(0)).count() == 0
