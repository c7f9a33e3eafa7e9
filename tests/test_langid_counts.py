"""Trigram counts against a plain loop."""

from collections import Counter

import numpy as np

from quillmark.operators import langid as li


def plain(texts, owner):
    out = Counter()
    for t, o in zip(texts, owner):
        for i in range(len(t) - 2):
            out[o, ord(t[i]) << 42 | ord(t[i + 1]) << 21 | ord(t[i + 2])] += 1
    return out


def test_counts_equal_a_plain_loop():
    rng = np.random.default_rng(3)
    signs = [*"abc ", "é", "你", "😀"]
    texts = ["", "a", "ab", *["".join(rng.choice(signs, n)) for n in (3, 4, 50, 4000)], "abcabc"]
    owner = np.array([0, 1, 2, 3, 3, 4, 5, 2])
    own, tri, n = li.count_trigrams(texts, owner)
    assert dict(zip(zip(own.tolist(), tri.tolist()), n.tolist())) == plain(texts, owner)
    many = ["".join(chr(256 + int(x)) for x in rng.integers(0, 30_000, 3000)) for _ in range(40)]  # numbers of 64 bits would not do
    own, tri, n = li.count_trigrams(many * 30, np.arange(1200) * 10 ** 6)
    got = Counter()
    for k, v in zip(zip(own.tolist(), tri.tolist()), n.tolist()):
        got[k] += v
    assert got == plain(many * 30, (np.arange(1200) * 10 ** 6).tolist())


def test_parts_and_counts_of_keys(spark, monkeypatch):
    monkeypatch.setattr(li, "AT_ONCE", 5)
    rows = [(1, 0, "aaaa"), (1, 1, "aaa"), (None, 0, "xyz"), (1, 0, "AAA"), (2, 0, "ab")]
    paras = spark.createDataFrame(rows, "doc_id long, par int, ptext string").coalesce(1)
    got = {(r.doc_id, r.par): r.n for r in li.trigram_counts(paras, ["doc_id", "par"]).collect()}
    assert got == {(1, 0): 3, (1, 1): 1, (None, 0): 1}
