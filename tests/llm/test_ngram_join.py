"""N-gram Jaccard join: components against all pairs, signature guarantee, one row of each group."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from quillmark.llm import ngram_join
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    """(doc_id, number of shingles, smallest id of the component) and the component's own number, per row."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids else None))
    return out, [find(k) for k in range(len(rows))]


def edited(text, seed, k):
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(k):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def near_rows():
    """A group of near copies around one base with growing distance, a chain, shared passages, short texts."""
    base, chain = prose(1000, 120), prose(2000, 90)
    rows = [(i, edited(base, i, i % 6)) for i in range(60)]
    for k in range(12):  # neighbours of the chain link, its ends do not
        chain = edited(chain, 3000 + k, 1)
        rows.append((100 + k, chain))
    line = prose(4000, 40)
    rows += [(200 + k, f"{prose(5000 + k, 30)} {line} {prose(6000 + k, 25)}") for k in range(30)]
    rows += [(300 + k, prose(7000 + k % 4, 4 + k % 9)) for k in range(40)]
    large = prose(8000, 700)  # sizes around the steps of the wide maps
    rows += [(400 + k, edited(" ".join(large.split(" ")[: 480 + 12 * k]), 8100 + k, k % 4)) for k in range(10)]
    return rows


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 70)])
def test_components_equal_all_pairs(make, awkward, n, percent):
    rows = near_rows() + [(1000 + (r[0] or 0) if r[0] is not None else None, r[1]) for r in awkward]
    got = ngram_join.near_classes(make(rows), n=n, percent=percent, classes=4, rare_limit=3).collect()
    want, _ = brute(rows, n, percent)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(want, key=key)


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_linked_sets_share_a_signature(percent):
    r = np.random.default_rng(percent)
    for _ in range(400):
        pool = r.integers(1, 2**63, 400).astype(np.uint64)
        freq_of = {int(h): int(f) for h, f in zip(pool, r.choice([1, 2, 50, 500], 400))}
        size = int(r.integers(1, 150))
        a = np.unique(r.choice(pool, size, replace=False))
        b = np.unique(np.concatenate([r.choice(a, max(1, len(a) - int(r.integers(0, 1 + len(a) // 5))), replace=False),
                                      r.choice(pool, int(r.integers(0, 1 + len(a) // 8)))]))
        common = len(np.intersect1d(a, b))
        if 100 * common < percent * (len(a) + len(b) - common):
            continue
        sign = [ngram_join.signatures(x, np.array([freq_of[int(h)] for h in x]), 10, percent, 4) for x in (a, b)]
        assert len(np.intersect1d(*sign))


def test_parity_maps_bound_the_difference():
    r = np.random.default_rng(3)
    for _ in range(100):
        a = np.unique(r.integers(1, 2**63, 60).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(r.integers(0, 60))], r.integers(1, 2**63, 20).astype(np.uint64)]))
        bits = sum(int(x ^ y).bit_count() if x ^ y >= 0 else int((x ^ y) & (2**64 - 1)).bit_count()
                   for x, y in zip(map(int, ngram_join.parity_map(a)), map(int, ngram_join.parity_map(b))))
        assert bits <= len(np.setxor1d(a, b))
    big = np.unique(r.integers(1, 2**63, 3000).astype(np.uint64))
    wide = ngram_join.wide_map(big)
    assert len(wide) * 64 >= len(big) and ngram_join.wide_map(big[:255]) is None
    half = len(wide) // 2  # folding gives the map of half the length
    assert (wide[:half] ^ wide[half:] == ngram_join.parity_map(big, half * 64)).all()


def test_one_of_each(make, awkward):
    rows = near_rows() + [(1000 + r[0] if r[0] is not None else None, r[1]) for r in awkward]
    docs = make(rows)
    kept = ngram_join.one_of_each(docs, n=3, percent=90, classes=4, rare_limit=3)
    assert kept.columns == docs.columns
    got = kept.collect()
    want, component = brute(rows, 3, 90)
    groups = {c: w[2] for c, w in zip(component, want) if w[1]}
    with_words = [r for r in got if shingles(r.text, 3)]
    assert sorted((r.doc_id is None, r.doc_id) for r in with_words) == sorted((i is None, i) for i in groups.values())
    assert len(got) - len(with_words) == sum(not w[1] for w in want)


def test_shingle_hashes_match_the_sets():
    sets = ngram_join.Sets(3)
    for text in ("", "a", "a b", "a b c", "a b c a b c", prose(1, 200)):
        (h,) = list(sets([text]))
        assert len(h) == len(shingles(text, 3))


def test_empty_table(make):
    none = make([(1, "a b c")]).limit(0)
    assert ngram_join.near_classes(none).count() == 0
    assert ngram_join.one_of_each(none).count() == 0


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_large_sets_share_a_signature_for_any_number_of_classes(percent):
    r = np.random.default_rng(percent)
    for size in (980, 1024, 1100, 4090, 4200):
        every = np.unique(r.integers(0, 2**63, 2 * size).astype(np.uint64))
        r.shuffle(every)
        for keep in (size * percent // 100 + 1, size):
            a = np.sort(every[:size])
            b = np.sort(every[size - keep: size + (0 if keep < size else size * (100 - percent) // percent)])
            sign = [ngram_join.signatures(x, np.full(len(x), 200, np.uint8), 10, percent, 8) for x in (a, b)]
            assert len(np.intersect1d(*sign)), (size, keep)


def test_signatures_grow_with_the_set():
    for n in (1000, 5000, 40_000):
        h = np.sort(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        assert len(ngram_join.signatures(h, np.full(n, 200, np.uint8), 10, 80, 8)) <= 6 * n


def test_sketch_counts(make):
    rows = [(i, "a b c d e f g" if i < 300 else prose(i, 30)) for i in range(330)]
    sets, bits = ngram_join.Sets(5), 16
    table = ngram_join.frequencies(make(rows).repartition(3), 5, bits)
    common = next(iter(sets(["a b c d e f g"])))
    assert table.dtype == np.uint8 and (table[ngram_join._bucket(common, bits)] == 255).all()
    rare = next(iter(sets([prose(310, 30)])))
    assert np.median(table[ngram_join._bucket(rare, bits)]) == 1


def test_a_shared_passage_signs_once(make, monkeypatch):
    passage, seen, real = prose(31, 300), {}, ngram_join.stage

    def kept(df, name):
        seen[name] = real(df, name)
        return seen[name]

    monkeypatch.setattr(ngram_join, "stage", kept)
    rows = [(k, f"{prose(500 + k, 40 + k)} {passage}") for k in range(20)]
    got = ngram_join.near_classes(make(rows), n=3, percent=70, classes=4).collect()
    want, _ = brute(rows, 3, 70)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(want, key=key)
    shared = seen["join_shared"]
    groups = [frozenset(r.nodes) for r in shared.groupBy("sig").agg({"node": "collect_set"}).toDF("sig", "nodes").collect()]
    assert shared.select("node").distinct().count() > 1 and len(groups) == len(set(groups))


def test_folded_maps_bound_the_difference_in_the_join(spark):
    from pyspark.sql import functions as F
    r = np.random.default_rng(9)
    rows, links = [], []
    for size in (200, 300, 511, 512, 900, 5000, 9000):
        for keep in (0.3, 0.75, 0.97):
            a = np.unique(r.integers(1, 2**63, size).astype(np.uint64))
            b = np.unique(np.concatenate([r.choice(a, int(len(a) * keep), replace=False),
                                          r.integers(1, 2**63, int(len(a) * (1 - keep))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            wide = [None if (m := ngram_join.wide_map(x)) is None else m.view(np.int64).tolist() for x in (a, b)]
            rows.append((len(rows), (len(a), wide[0]), (len(b), wide[1])))
            links.append((100 * common >= 90 * (len(a) + len(b) - common), keep, size))
    struct = "struct<n:int,wide:array<long>>"
    df = spark.createDataFrame(rows, f"i int, a {struct}, b {struct}")
    a, b = (F.struct(F.col(f"{c}.n"), ngram_join._folded(F.col(f"{c}.wide")).alias("wide")) for c in "ab")
    got = df.select("i", a.alias("a"), b.alias("b")).select(
        "i", F.greatest(F.size("a.wide"), F.size("b.wide")).alias("words"),
        ngram_join._wide_near(F.col("a"), F.col("b"), 90).alias("near")).orderBy("i").collect()
    for x, (linked, keep, size) in zip(got, links):
        assert (x.words or 0) <= 64 and (x.near or not linked)
        assert x.near if size < 250 else not x.near or keep > 0.9 or size > 4096
    whole = ngram_join.wide_map(np.arange(1, 9001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    folded = spark.createDataFrame([(whole.view(np.int64).tolist(),)], "w array<long>").select(ngram_join._folded(F.col("w"))).first()[0]
    assert folded == np.bitwise_xor.reduce(whole.reshape(-1, 64)).view(np.int64).tolist()
