"""Pitman-Yor model: base scores by hand, probabilities that add up, Gibbs against the exact law, held-out gain."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillmark.llm import pitman_yor
from quillmark.sources.tables import table
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), "\n"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def check(rows, got):
    count = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        ts = tokens(t)
        want.append((i, held(i), len(ts), sum(count[x] > 0 for x in ts), n,
                     sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(mine, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


def test_base_scores(make, awkward):
    rows = awkward + [(100 + i, prose(i, 30)) for i in range(30)]
    got = pitman_yor.score(make(rows), buckets=5, at_once=2000).collect()
    check(rows, got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_held_out_gain(spark, sf):
    docs = table(spark, sf, "documents")
    got = pitman_yor.score(docs).toPandas()
    assert len(got) == docs.count()
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()
    assert (out.score > out.base_score).mean() > 0.8


def _model(seed=3):
    """Totals, dishes and seats of a small corpus in one bucket."""
    key, count = pitman_yor.Tokens()([prose(i, 40) for i in range(30)])
    cells, n = np.unique(key, return_counts=True)
    d = pitman_yor.Dishes(cells, n.astype(np.int64))
    rng = np.random.default_rng(seed)
    kind, up = np.bincount(d.kind, minlength=257), np.bincount(d.up_kind, minlength=17)
    t = pitman_yor.Totals([np.array([up.sum()]), np.bincount(np.arange(257) >> 4, weights=kind, minlength=17),
                           np.bincount(d.kind, weights=n, minlength=257)], [np.array([len(d.words)]), up, kind],
                          int(n.sum()), len(d.words), [0.5, 0.6, 0.7], [1.0, 1.0, 1.0])
    seats = pitman_yor._sweep(d, t, None, 2, rng)
    for _ in range(3):
        low, mid, top = seats
        t = pitman_yor.Totals(
            [np.array([top.customers.sum()]), np.bincount(d.up_kind, weights=mid.customers, minlength=17), t.customers[2]],
            [np.array([top.tables.sum()]), np.bincount(d.up_kind, weights=mid.tables, minlength=17),
             np.bincount(d.kind, weights=low.tables, minlength=257)], t.n, t.v, t.discounts, t.strengths)
        last = [pitman_yor.Seating(s.dish.copy(), s.size.copy(), s.dishes) for s in seats]
        seats = pitman_yor._sweep(d, t, seats, 2, rng)
    return d, t, last


def test_probabilities_add_up():
    d, t, (low, mid, top) = _model()
    root, up = d.predict(t, top.customers, top.tables, mid.customers, mid.tables)
    unseen = t.unseen()
    for k in np.unique(d.kind):
        p = k >> 4
        above = t.new(1)[p] * root / t.room(1)[p]
        own = d.up_kind == p
        above[d.up_word[own]] = up[own]
        mine = t.new(2)[k] * above / t.room(2)[k]
        at = d.kind == k
        mine[d.word[at]] += (d.counts[at] - t.discounts[2] * low.tables[at]) / t.room(2)[k]
        assert mine.sum() + unseen[k] == pytest.approx(1, abs=1e-9)


def test_seating_stays_whole():
    d, _, (low, mid, top) = _model()
    assert (low.customers == d.counts).all() and (low.size > 0).all()
    assert (mid.customers == np.bincount(d.up, weights=low.tables)).all()
    assert (top.customers == np.bincount(d.up_word, weights=mid.tables)).all()


def test_gibbs_follows_the_exact_law():
    """Tables of four customers of one dish: frequencies against all seatings."""
    new, discount, n = 0.8, 0.4, 4

    def weight(blocks):  # new tables by weight, others by size less discount; the dish's normaliser varies with neither
        w = 1.0
        for b in blocks:
            w *= new * math.prod(j - discount for j in range(1, len(b)))
        return w

    def partitions(items):
        if not items:
            yield []
            return
        head, rest = items[0], items[1:]
        for k in range(len(rest) + 1):
            for others in itertools.combinations(rest, k):
                left = [x for x in rest if x not in others]
                for p in partitions(left):
                    yield [[head, *others], *p]

    law = Counter()
    for p in partitions(list(range(n))):
        law[len(p)] += weight(p)
    total = sum(law.values())
    rng = np.random.default_rng(8)
    dishes = 4000
    s = pitman_yor.Seating(np.arange(dishes), np.full(dishes, n), dishes)
    s.move(np.full(dishes, new), discount, 60, rng)
    seen = np.bincount(s.tables, minlength=n + 1)
    for k in range(1, n + 1):
        assert seen[k] / dishes == pytest.approx(law[k] / total, abs=0.03)


def test_packing():
    a, b = np.array([3, 1, 2], dtype=np.uint64), np.array([], dtype=np.int32)
    x, y = pitman_yor.unpack(pitman_yor.pack(a, b))
    assert (x == a).all() and x.dtype == a.dtype and len(y) == 0
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64))
    assert (pitman_yor._unpack_cells(pitman_yor._pack_cells(keys))[0] == keys).all()


def test_nothing_to_learn(make):
    only = next(i for i in range(100) if held(i))
    (r,) = pitman_yor.score(make([(only, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score)
    assert pitman_yor.score(make([(1, "a")]).limit(0)).count() == 0


def test_groups_of_many_customers_follow_the_exact_law():
    """Tables of 60 customers of one dish: mean and spread against the law by generalised Stirling numbers."""
    new, discount, n = 1.5, 0.4, 60
    s = np.zeros(n + 2)
    s[1] = 1.0
    for j in range(1, n):  # ways to seat j + 1 customers at k tables, scaled to stay finite
        s[1:] = (s[:-1] + (j - discount * np.arange(1, n + 2)) * s[1:]) / (j + 1)
        s[j + 2:] = 0
    k = np.arange(n + 2)
    law = s * new ** k
    law /= law.sum()
    mean = (law * k).sum()
    spread = math.sqrt((law * k * k).sum() - mean ** 2)
    rng = np.random.default_rng(5)
    dishes = 3000
    seats = pitman_yor.first_seating(np.full(dishes, n), np.full(dishes, new), discount, rng)
    seats.move(np.full(dishes, new), discount, 30, rng)
    assert (seats.customers == n).all() and (seats.size > 0).all() and (np.diff(seats.dish) >= 0).all()
    assert seats.tables.mean() == pytest.approx(mean, rel=0.05)
    assert seats.tables.std() == pytest.approx(spread, rel=0.1)


def test_moves_grow_with_the_customers():
    """A dish of a million customers at one table is spread over tables within a sweep."""
    rng = np.random.default_rng(2)
    seats = pitman_yor.Seating(np.array([0, 1]), np.array([1_000_000, 3]), 2)
    seats.move(np.array([50.0, 1.0]), 0.5, 2, rng)
    assert seats.customers.tolist() == [1_000_000, 3]
    assert seats.tables[0] > 13 and seats.size.max() < 1_000_000  # twelve single moves could open twelve


def test_the_token_before_is_the_context(make):
    """Two words with one ending, each before its own colour: only the word itself tells which."""
    rows = [(i, f"{a}qqoo {b}") for i, (a, b) in enumerate([("left", "red"), ("right", "blue")] * 100)]
    rows += [(1000 + 10 * k + i, f"{a}qqoo {b}") for k, (a, b) in enumerate(
        itertools.product(("left", "right"), ("red", "blue"))) for i in range(10) if held(1000 + 10 * k + i)]
    got = {r.doc_id: r.score for r in pitman_yor.score(make(rows), buckets=5).collect()}
    score = {t: got[i] for i, t in rows if i >= 1000}
    assert score["leftqqoo red"] > score["leftqqoo blue"] + 0.7
    assert score["rightqqoo blue"] > score["rightqqoo red"] + 0.7


@pytest.mark.parametrize("before", [None, "0"])
def test_probabilities_after_a_token_add_up(spark, before):
    """All words, the end and an unknown word, after the start of a text or a frequent word, over seven buckets."""
    buckets, learned = 7, [prose(i, 40) for i in range(30)]
    count = Counter(w for t in learned for w in WORD.findall(t.translate(LOWER)))
    first = [] if before is None else [count.most_common(1)[0][0]]
    asked = [" ".join([*first, w]) for w in [*count, "neverseen"]] + [" ".join(first)]
    rows = []
    for name, texts in (("learned", learned), ("asked", asked)):
        keys, n = pitman_yor.Tokens()(texts)
        p = pitman_yor.Pairs([keys], n)
        times = np.bincount(p.at, minlength=len(p.keys)).astype(np.uint32) * (name == "learned")
        place = pitman_yor._bucket(p.keys, buckets)
        rows += [(name, int(k), pitman_yor._pack_pairs(p.keys[place == k], p.context[place == k],
                                                       times[place == k].astype(np.uint32))) for k in np.unique(place)]
    merged = (spark.createDataFrame(rows, "batch string, bucket int, data binary").groupBy("bucket")
              .applyInPandas(lambda x: pitman_yor._merge(x, buckets), pitman_yor.MERGED).cache())
    wants, model, every, corpus = pitman_yor.learn(merged, 1, 2, 1, 3, buckets)
    wants, model = wants.where("batch = 'asked'").toPandas(), model.toPandas()
    answers = [pitman_yor._answer(every, w, model[model.bucket == k]) for k, w in wants.groupby("bucket")]
    end = np.cumsum(n)
    at = np.concatenate([p.at[a - m: a - (i < len(n) - 1)] for i, (a, m) in enumerate(zip(end, n))])  # the last one ends
    size = np.where(np.arange(len(n)) < len(n) - 1, n - 1, n).astype(np.uint32)
    null, out = np.zeros(len(n), dtype=bool), np.zeros(len(n), dtype=bool)
    docs = pitman_yor.pd.DataFrame({"data": [pitman_yor.pack(at, size, np.arange(len(n)), null, out)]})
    got = pitman_yor._score(every, corpus, docs, pitman_yor.pd.concat(answers))
    head = 0.0
    if first:  # the probability of the first word itself
        only = pitman_yor.pack(p.at[end[-1] - n[-1]: end[-1] - 1], np.array([1], dtype=np.uint32), np.zeros(1, dtype=np.int64),
                               null[:1], out[:1])
        head = pitman_yor._score(every, corpus, pitman_yor.pd.DataFrame({"data": [only]}),
                                 pitman_yor.pd.concat(answers)).score.iloc[0]
    assert (10 ** (got.score - head)).sum() == pytest.approx(1, abs=1e-4)


def test_lone_customers_stay_among_the_others():
    rng = np.random.default_rng(4)
    customers = np.array([1, 1, 5, 1, 40, 1, 1])
    seats = pitman_yor.Seating(np.arange(7), customers.copy(), 7)
    seats.move(np.full(7, 2.0), 0.5, 5, rng)
    assert (seats.customers == customers).all() and (np.diff(seats.dish) >= 0).all() and (seats.tables[[2, 4]] > 1).any()
    seats.follow(customers + np.array([0, 3, 0, 0, -30, 0, 0]), np.full(7, 2.0), 0.5, rng)
    assert seats.customers.tolist() == [1, 4, 5, 1, 10, 1, 1] and (np.diff(seats.dish) >= 0).all()


def packed_pairs(batches, n):
    """Pairs of some batches in one bucket, as the reading stage packs them."""
    rng = np.random.default_rng(1)
    rows = []
    for b in range(batches):
        keys = np.sort(rng.integers(0, 500, n).astype(np.uint64) << np.uint64(45) | rng.integers(0, 257, n).astype(np.uint64))
        context = rng.integers(0, 500, n).astype(np.uint64) << np.uint64(20)
        rows.append(("cells", f"b{b}", 0, pitman_yor._pack_pairs(keys, context, np.ones(n, dtype=np.uint32))))
    return pitman_yor.pd.DataFrame(rows, columns=["kind", "batch", "bucket", "data"])


def test_a_bucket_is_merged_in_little_memory():
    """Bytes a pair that merging holds at once, and rows that come and go in pieces."""
    import tracemalloc
    pairs = packed_pairs(20, 25_000)
    tracemalloc.start()
    whole = pitman_yor._merge(pairs, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110 * 500_000  # it was 157 bytes a pair
    pieces = list(pitman_yor._merged((pairs[i: i + 3] for i in range(0, 20, 3)), 7))
    assert pitman_yor.pd.concat(pieces, ignore_index=True).equals(whole.reset_index(drop=True))
    rows = [("x", bytes(n)) for n in (1, 5, 9, 2, 2)]
    assert [len(x) for x in pitman_yor._in_pieces(rows, 6)] == [2, 1, 2]


def test_a_sweep_sends_one_row_of_class_totals():
    """Totals of classes and root travel packed; a place without contexts adds them up as well."""
    parts = [[np.full(n, float(k)) for n in pitman_yor.SUMS.values()] for k in (1, 2)]
    group = pitman_yor._frame([("sums", 3, k, 0.0, pitman_yor.pack(*x)) for k, x in enumerate(parts)])
    got = pitman_yor._context_totals(group)
    assert got.groupby("kind").size().to_dict() == pitman_yor.SUMS and (got.value == 3).all()
