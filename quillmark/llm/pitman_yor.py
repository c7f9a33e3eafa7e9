"""Language-model scores under a hierarchical Pitman-Yor model.

Restaurants: a token's context is the token before it, the start of a text being one
more; every context has its own restaurant, however many there are.  Contexts with the same
ending back off together: the parent of a context is one of 256 classes of its last two
bytes (plus one for the start), the parent of a class one of 16 classes of the last byte; above
them stand one root restaurant and a uniform base over the V learned
tokens and one unknown token.  Tables of a restaurant are customers of its parent.

Seating is sampled by Gibbs: a sweep takes every customer (``steps`` times, on average) from
its table and seats it again, at an old table by its size less the
discount, at a new one by the parent's predictive probability; tables that open or
close add or remove a customer upstairs.  Dishes of many customers move a sixteenth of them at
a time, drawn per table, so the work of a sweep follows customers for rare dishes and tables for
frequent ones.  A pair of tokens seen once always has a table to itself and is kept as a count.
Dishes meet only in the restaurants'
totals, so a sweep runs over buckets of dishes in parallel with the totals of the
sweep before.  Totals of classes are a few hundred numbers; those of contexts follow the
vocabulary, so they lie in places by the context's hash, which sum what the buckets
of dishes send and answer each with the contexts that it has.  After the burn-in every sweep is a sample, and the predictive probabilities are
averaged over the samples.

Data flow: one pass over the texts turns batches of documents into distinct
(token, context) pairs with learning counts, packed by bucket of the token's hash, and
the documents' pair numbers.  Counts, seating and answers live in the buckets; each
batch gets back what its distinct pairs, cells (token and class) and words have there and puts the
probabilities together.  Pairs of a frequent token are at most as many as there are words.

Tokens are named by 55 bits of a 64-bit hash, contexts by the first 40 of these.

Defined cases: a null text is an empty one (its only token is the end); a null
``doc_id`` is learned from; repeated rows count and are scored each; with nothing to
learn from every count is 0 and the base is uniform over the unknown token; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Rolling, by_size, parts, texts_of, word_hashes
from quillmark.session import drop_path, fresh_path, stage

CLASSES, PARENTS = 257, 17          # class 256 (parent 16) is the start of a text
WORD_BITS, CLASS_BITS = 55, 9
CONTEXT_BITS = 40                   # the first bits of a word's hash; 0 is the start of a text
END = np.uint64(0x5EED << CLASS_BITS)  # the key of the end; a word's hash meets it with probability 2**-55


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; bytes of equal weight lie together, so sorted numbers shrink."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(np.array([len(a)], dtype="<i8").tobytes() + a.dtype.str.encode().ljust(8))
        out.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(bytes(data)), 0, []
    while at < len(data):
        n = int(np.frombuffer(data, dtype="<i8", count=1, offset=at)[0])
        kind = np.dtype(data[at + 8: at + 16].decode().strip())
        size = n * kind.itemsize
        flat = np.frombuffer(data, dtype=np.uint8, count=size, offset=at + 16)
        out.append(np.ascontiguousarray(flat.reshape(kind.itemsize, n).T).view(kind).ravel())
        at += 16 + size
    return out


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, word of each cell, class of each cell) of sorted cell keys."""
    word = keys >> np.uint64(CLASS_BITS)
    first = np.concatenate([[True], word[1:] != word[:-1]]) if len(word) else np.zeros(0, dtype=bool)
    return word[first], np.cumsum(first) - 1, (keys & np.uint64((1 << CLASS_BITS) - 1)).astype(np.int64)


def _pack_cells(keys: np.ndarray, *more: np.ndarray) -> bytes:
    words, at, kind = _split(keys)
    step = np.diff(words, prepend=np.uint64(0))
    return pack(step, np.bincount(at, minlength=len(words)).astype(np.uint16), kind.astype(np.uint16), *more)


def _unpack_cells(data: bytes) -> tuple[np.ndarray, ...]:
    step, cells, kind, *more = unpack(data)
    words = np.cumsum(step, dtype=np.uint64)
    return np.repeat(words, cells) << np.uint64(CLASS_BITS) | kind.astype(np.uint64), *more


class Tokens:
    """Cell keys of texts: word hash and context class of every token, the end included."""

    def __init__(self):
        self.rolling = Rolling()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(keys of all texts one after the other, tokens per text)."""
        words, last, more, n = word_hashes(texts, self.rolling, ends=True)
        count = n + 1
        keys = np.empty(count.sum(), dtype=np.uint64)
        context = np.empty(len(keys), dtype=np.uint64)
        stop = np.cumsum(count)
        inner = np.ones(len(keys), dtype=bool)
        inner[stop - 1] = False
        keys[inner], keys[stop - 1] = words >> np.uint64(CLASS_BITS) << np.uint64(CLASS_BITS), END
        context[np.flatnonzero(inner) + 1] = (last & np.uint64(15)) << np.uint64(4) | more & np.uint64(15)
        context[stop - count] = CLASSES - 1
        return keys | context, count


class Pairs:
    """Distinct pairs of a token and the token before it, in order of word, class and context."""

    def __init__(self, keys: list[np.ndarray], count: np.ndarray):
        """From the cell keys of texts, which are taken, and tokens per text; ``at`` is the pair of each token."""
        taken, keys = keys, np.concatenate(keys)
        taken.clear()
        word = keys >> np.uint64(CLASS_BITS)
        words = np.unique(word)
        word = np.searchsorted(words, word).astype(np.uint32)
        starts = np.zeros(len(keys), dtype=bool)
        starts[np.cumsum(count) - count] = True
        class_of = np.zeros(len(words), dtype=np.uint64)
        before = np.concatenate([[np.uint32(0)], word[:-1]])
        class_of[before[~starts]] = (keys & np.uint64((1 << CLASS_BITS) - 1))[~starts]
        del keys
        codes, code = np.unique(class_of << np.uint64(CONTEXT_BITS) | context_of(words), return_inverse=True)
        codes = np.append(codes, np.uint64((CLASSES - 1) << CONTEXT_BITS))  # the start, after all others
        before = code.astype(np.uint32)[before]
        before[starts] = len(codes) - 1
        pair = word.astype(np.uint64)
        pair <<= np.uint64(32)
        pair |= before
        del word, before
        order = np.argsort(pair)
        pair = pair[order]
        new = np.ones(len(pair), dtype=bool)
        new[1:] = pair[1:] != pair[:-1]
        pair = pair[new]
        self.at = np.empty(len(order), dtype=np.uint32)
        self.at[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        own = codes[pair & np.uint64(0xFFFFFFFF)]
        self.keys = words[pair >> np.uint64(32)] << np.uint64(CLASS_BITS) | own >> np.uint64(CONTEXT_BITS)
        self.context = own & np.uint64((1 << CONTEXT_BITS) - 1)


def context_of(words: np.ndarray) -> np.ndarray:
    return words >> np.uint64(WORD_BITS - CONTEXT_BITS)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where runs of equal values begin, length of each)."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.append(first, len(values)))


def _columns(rows: list[tuple]) -> Iterator[list]:
    """The columns of rows, which are taken, one after the other; each is let go when the next one is asked for."""
    columns = [list(c) for c in zip(*rows)]
    rows.clear()
    while columns:
        yield columns.pop(0)


def _pack_pairs(keys: np.ndarray, *more: np.ndarray) -> bytes:
    first, n = _runs(keys)
    return _pack_cells(keys[first], n.astype(np.uint32), *more)


def _unpack_pairs(data: bytes) -> tuple[np.ndarray, ...]:
    keys, n, *more = _unpack_cells(data)
    return np.repeat(keys, n), *more


def _steps(places: np.ndarray) -> np.ndarray:
    """Ascending numbers as their differences, which shrink well."""
    return np.diff(places, prepend=places.dtype.type(0))


def _in_pieces(rows: Iterable[tuple], at_once: int = 1 << 22) -> Iterator[list[tuple]]:
    """Runs of rows with about ``at_once`` bytes of data (the last column), made as they are asked for."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[-1] or b"")
        if size >= at_once:
            yield some
            some, size = [], 0
    if some:
        yield some


READ = "kind string, batch string, bucket int, data binary"


def _read(rows: DataFrame, buckets: int, at_once: int, step: int) -> DataFrame:
    """Packed pairs by bucket (kind cells) and packed documents (kind docs) of every batch of texts."""
    def batch(keys: list, counts: list, ids: list, held_parts: list) -> Iterator[tuple]:
        name = uuid.uuid4().hex  # written once, with its rows
        count, held = np.concatenate(counts), np.concatenate(held_parts)
        pairs = Pairs(keys, count)
        learned = np.bincount(pairs.at[np.repeat(~held, count)], minlength=len(pairs.keys)).astype(np.uint32)
        null = np.array([i is None for i in ids], dtype=bool)
        docs = pack(pairs.at, count.astype(np.uint32), np.array([i or 0 for i in ids], dtype=np.int64),
                    null, held)
        yield "docs", name, 0, docs
        del docs, pairs.at
        place = _bucket(pairs.keys, buckets)
        cut = np.searchsorted(place, np.arange(buckets + 1))
        for k in range(buckets):
            a, b = cut[k], cut[k + 1]
            if a < b:
                yield "cells", name, k, _pack_pairs(pairs.keys[a:b], pairs.context[a:b], learned[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held_parts = Tokens(), []
        keys, counts, ids, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for some in _in_pieces(batch(keys, counts, ids, held_parts)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*some), (pa.string(), pa.string(), pa.int32(), pa.binary()))],
                    names=[c.split()[0] for c in READ.split(", ")])

        for b in batches:
            texts, own = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            held = np.array(b.column("held_out").to_pylist(), dtype=bool)
            for first, last in by_size(texts, step):
                k, c = tokens(texts[first:last])
                keys.append(k)
                counts.append(c)
                ids += own[first:last]
                held_parts.append(held[first:last])
                size += sum(len(t or "") + 1 for t in texts[first:last])
                if size >= at_once:
                    yield from flush()
                    keys, counts, ids, held_parts, size = [], [], [], [], 0
        if keys:
            yield from flush()

    return rows.mapInArrow(run, READ)


def _bucket(cells: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each cell by the first bits of its word's hash, so buckets follow the order of the cells."""
    return ((cells >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _width(buckets: int) -> int:
    """Buckets whose contexts lie in one place: about as many as there are places, so what they send stays few rows."""
    return math.isqrt(max(buckets - 1, 0)) + 1


def _context_bucket(contexts: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each context: that of its own word."""
    return _bucket(contexts << np.uint64(64 - CONTEXT_BITS), buckets)


class Seating:
    """Tables of many dishes: the dish of each table, in order, and its customers."""

    def __init__(self, dish: np.ndarray, size: np.ndarray, dishes: int):
        self.dish, self.size, self.dishes = dish, size, dishes

    @property
    def tables(self) -> np.ndarray:
        return np.bincount(self.dish, minlength=self.dishes)

    @property
    def customers(self) -> np.ndarray:
        return np.bincount(self.dish, weights=self.size, minlength=self.dishes).astype(np.int64)

    def part(self, dishes: np.ndarray) -> Seating:
        """Tables of some dishes (ascending), which are numbered anew."""
        number = np.full(self.dishes, -1)
        number[dishes] = np.arange(len(dishes))
        own = number[self.dish]
        mine = own >= 0
        return Seating(own[mine], self.size[mine], len(dishes))

    def put(self, dishes: np.ndarray, seats: Seating) -> None:
        """Tables of some dishes take the place of those they had."""
        others = np.ones(self.dishes, dtype=bool)
        others[dishes] = False
        stay = others[self.dish]
        dish = np.concatenate([self.dish[stay], dishes[seats.dish]])
        order = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[order], np.concatenate([self.size[stay], seats.size])[order]

    def _span(self, dishes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first table of each of these dishes, the one after its last)."""
        return np.searchsorted(self.dish, dishes, "left"), np.searchsorted(self.dish, dishes, "right")

    def _pick(self, dishes: np.ndarray, discount: float, rng) -> np.ndarray:
        """One table of each of these dishes, by its size less the discount; no other tables are looked at."""
        first, stop = self._span(dishes)
        n = stop - first
        end = np.cumsum(n)
        tables = np.arange(end[-1]) + np.repeat(stop - end, n)
        weight = self.size[tables] - discount
        upto = np.cumsum(weight)
        low, high = upto[end - n] - weight[end - n], upto[end - 1]
        at = np.searchsorted(upto, low + rng.random(len(dishes)) * (high - low), "right")
        return tables[np.clip(at, end - n, end - 1)]

    def leave(self, dishes: np.ndarray, rng) -> None:
        """A random customer of each of these dishes leaves; empty tables close."""
        at = self._pick(dishes, 0.0, rng)
        self.size[at] -= 1
        closed = at[self.size[at] == 0]
        if len(closed):
            self.dish, self.size = np.delete(self.dish, closed), np.delete(self.size, closed)

    def enter(self, dishes: np.ndarray, new: np.ndarray, discount: float, rng) -> None:
        """A customer of each of these dishes sits down; ``new`` is the weight of a new table per dish."""
        first, stop = self._span(dishes)
        upto = np.concatenate([[0], np.cumsum(self.size)])
        old = upto[stop] - upto[first] - discount * (stop - first)
        opens = rng.random(len(dishes)) * (old + new[dishes]) < new[dishes]
        opens |= old <= 0
        join = dishes[~opens]
        if len(join):
            self.size[self._pick(join, discount, rng)] += 1
        fresh, at = dishes[opens], stop[opens]
        self.dish, self.size = np.insert(self.dish, at, fresh), np.insert(self.size, at, 1)

    def move(self, new: np.ndarray, discount: float, steps: int, rng, groups: int = 16) -> None:
        """Gibbs: ``steps`` times as many customers of every dish as it has leave and sit down again.

        Dishes of up to ``groups`` customers move them one at a time.  In larger ones each customer
        leaves with chance 1 / ``groups`` in each of ``groups`` grouped steps.
        """
        customers = self.customers  # no move changes them; a lone customer always opens its own table again
        several = np.flatnonzero(customers > 1)
        if not len(several):
            return
        if 2 * len(several) <= self.dishes:
            seats = self.part(several)
            seats.move(new[several], discount, steps, rng, groups)
            self.put(several, seats)
            return
        large = np.flatnonzero(customers > groups)
        for _ in range(steps):
            for k in range(groups):
                small = np.flatnonzero((customers > max(k, 1)) & (customers <= groups))
                if len(small):
                    self.leave(small, rng)
                    self.enter(small, new, discount, rng)
                if len(large):
                    self._move_group(large, customers, new, discount, 1 / groups, rng)

    def _move_group(self, large: np.ndarray, customers: np.ndarray, new: np.ndarray, discount: float, share: float,
                    rng) -> None:
        """Each customer of the ``large`` dishes leaves with chance ``share`` and meets the others' tables as they stand.

        Draws are per table, so work and memory follow the tables, not the customers.
        """
        moving = np.zeros(self.dishes, dtype=bool)
        moving[large] = True
        at = np.flatnonzero(moving[self.dish])
        out = rng.binomial(self.size[at], share)
        leaving = np.bincount(self.dish[at], weights=out, minlength=self.dishes).astype(np.int64)[large]
        old = np.maximum(customers - 1 - discount * self.tables, 0)[large]
        opens = rng.binomial(leaving, new[large] / (new[large] + old))
        self.size[at] -= out
        staying = customers[large] - leaving
        opens = np.where((staying == 0) & (leaving > 0), np.maximum(opens, 1), opens)
        join = np.zeros(self.dishes, dtype=np.int64)
        join[large] = leaving - opens
        fresh = np.repeat(large, opens)
        place = np.searchsorted(self.dish, fresh, "right")
        weight = np.where(self.size > 0, self.size - discount, 0.0)
        empty = large[staying == 0]
        if len(empty):  # everyone left: the new tables are the only ones
            weight = np.insert(weight, place, np.where(np.isin(fresh, empty), 1 - discount, 0.0))
        else:
            weight = np.insert(weight, place, 0.0)
        self.dish, self.size = np.insert(self.dish, place, fresh), np.insert(self.size, place, 1)
        self.size += self._deal(weight, join, rng)
        stay = self.size > 0
        self.dish, self.size = self.dish[stay], self.size[stay]

    def _deal(self, weight: np.ndarray, number: np.ndarray, rng) -> np.ndarray:
        """Customers per table when ``number`` of each dish choose by weight: halves of its tables share them binomially."""
        upto = np.concatenate([[0.0], np.cumsum(weight)])
        dishes = np.flatnonzero(number)
        low, high = np.searchsorted(self.dish, dishes, "left"), np.searchsorted(self.dish, dishes, "right")
        number, out = number[dishes], np.zeros(len(weight), dtype=np.int64)
        while len(number):
            one = high - low == 1
            out[low[one]] = number[one]
            low, high, number = low[~one], high[~one], number[~one]
            middle = (low + high) // 2
            whole = upto[high] - upto[low]
            chance = np.divide(upto[middle] - upto[low], whole, out=np.zeros(len(whole)), where=whole > 0)
            left = rng.binomial(number, np.clip(chance, 0, 1))
            low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
            number = np.concatenate([left, number - left])
            some = number > 0
            low, high, number = low[some], high[some], number[some]
        return out

    def follow(self, wanted: np.ndarray, new: np.ndarray, discount: float, rng) -> None:
        """Customers leave or enter until every dish has as many as the tables downstairs."""
        while True:
            gap = wanted - self.customers
            open_ = np.flatnonzero(gap)
            if not len(open_):
                return
            if 2 * len(open_) <= self.dishes:
                seats = self.part(open_)
                seats.follow(wanted[open_], new[open_], discount, rng)
                self.put(open_, seats)
                return
            less, more = np.flatnonzero(gap < 0), np.flatnonzero(gap > 0)
            if len(less):
                self.leave(less, rng)
            if len(more):
                self.enter(more, new, discount, rng)


def first_seating(customers: np.ndarray, new: np.ndarray, discount: float, rng) -> Seating:
    """A start near the prior: customers come in growing groups, each opening a binomial number of tables."""
    tables, seated = np.ones(len(customers)), np.ones(len(customers))
    going = np.flatnonzero(customers > 1)
    while len(going):
        group = np.minimum(np.maximum(1, seated[going] // 8), customers[going] - seated[going])
        chance = new[going] / (new[going] + seated[going] + group / 2 - discount * tables[going])
        tables[going] += rng.binomial(group.astype(np.int64), np.clip(chance, 0, 1))
        seated[going] += group
        going = going[seated[going] < customers[going]]
    tables = tables.astype(np.int64)
    dish = np.repeat(np.arange(len(customers)), tables)
    share = rng.gamma(1 - discount, size=len(dish))
    total = np.bincount(dish, weights=share, minlength=len(customers))
    size = 1 + np.floor(share / total[dish] * (customers - tables)[dish]).astype(np.int64)
    first = np.cumsum(tables) - tables
    size[first] += customers - np.bincount(dish, weights=size, minlength=len(customers)).astype(np.int64)
    return Seating(dish, size, len(customers))


class Totals:
    """What dishes share: customers and tables by restaurant, learned tokens N, types V, discounts, strengths.

    Levels 0 to 2 are the root and the classes; level 3, the contexts, has only its discount and strength here and the
    customers and tables of the start of a text.
    """

    def __init__(self, customers: list[np.ndarray], tables: list[np.ndarray], n: int, v: int, discounts: list[float],
                 strengths: list[float], start: tuple[float, float] = (0.0, 0.0)):
        self.start = start
        self.customers, self.tables, self.n, self.v = customers, tables, n, v
        self.discounts, self.strengths = discounts, strengths

    def new(self, level: int) -> np.ndarray:
        """Weight of a new table before the parent's probability, by restaurant of a level (0 is the root)."""
        return self.strengths[level] + self.discounts[level] * self.tables[level]

    def room(self, level: int) -> np.ndarray:
        return self.strengths[level] + self.customers[level]

    @property
    def base(self) -> float:
        return 1 / (self.v + 1)

    def unseen(self) -> np.ndarray:
        """Probability of a token that no restaurant knows, by lowest class."""
        root = self.new(0)[0] * self.base / self.room(0)[0]
        up = self.new(1) * root / self.room(1)
        return self.new(2) * up[_parent(np.arange(CLASSES))] / self.room(2)


def _parent(classes: np.ndarray) -> np.ndarray:
    return classes >> 4


class Dishes:
    """A bucket's learned cells: word, class and count; parents' cells and words by number."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.words, self.word, self.kind = _split(keys)
        above = self.word * PARENTS + _parent(self.kind)
        first = np.concatenate([[True], above[1:] != above[:-1]]) if len(above) else np.zeros(0, dtype=bool)
        self.up = np.cumsum(first) - 1  # cell -> cell of the parent
        self.up_word, self.up_kind = self.word[first], _parent(self.kind)[first]
        self.total = np.bincount(self.word, weights=counts, minlength=len(self.words)).astype(np.int64)

    def predict(self, t: Totals, n0, t0, n1, t1) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each word at the root, and of each parent cell's word in its restaurant."""
        root = (n0 - t.discounts[0] * t0 + t.new(0)[0] * t.base) / t.room(0)[0]
        up = (n1 - t.discounts[1] * t1 + t.new(1)[self.up_kind] * root[self.up_word]) / t.room(1)[self.up_kind]
        return root, up


def _sweep(d: Dishes, t: Totals, seats: list[Seating] | None, steps: int, rng) -> list[Seating]:
    """One Gibbs sweep of a bucket from the lowest restaurants up; without seats, a first seating."""
    if seats is None:
        n1 = np.bincount(d.up, minlength=len(d.up_word))
        n0 = np.bincount(d.up_word, minlength=len(d.words))
        root, up = d.predict(t, n0, np.minimum(n0, 1), n1, np.minimum(n1, 1))
    else:
        low, mid, top = seats
        root, up = d.predict(t, top.customers, top.tables, mid.customers, mid.tables)
    new2 = t.new(2)[d.kind] * up[d.up]
    new1 = t.new(1)[d.up_kind] * root[d.up_word]
    new0 = np.full(len(d.words), t.new(0)[0] * t.base)
    if seats is None:
        low = first_seating(d.counts, new2, t.discounts[2], rng)
        mid = first_seating(np.bincount(d.up, weights=low.tables).astype(np.int64), new1, t.discounts[1], rng)
        top = first_seating(np.bincount(d.up_word, weights=mid.tables).astype(np.int64), new0, t.discounts[0], rng)
        return [low, mid, top]
    low.move(new2, t.discounts[2], steps, rng)
    mid.follow(np.bincount(d.up, weights=low.tables, minlength=len(d.up_word)).astype(np.int64), new1,
               t.discounts[1], rng)
    mid.move(new1, t.discounts[1], steps, rng)
    top.follow(np.bincount(d.up_word, weights=mid.tables, minlength=len(d.words)).astype(np.int64), new0,
               t.discounts[0], rng)
    top.move(new0, t.discounts[0], steps, rng)
    return [low, mid, top]


class Bucket:
    """Learned pairs of a bucket seen more than once, and its cells with the number of pairs seen once.

    ``cell`` and ``context`` are numbers of a pair's cell and of its context among those of the bucket.
    """

    def __init__(self, d: Dishes, once: np.ndarray, cell: np.ndarray, context: np.ndarray, count: np.ndarray, contexts: int):
        self.d, self.once, self.cell, self.context, self.count, self.contexts = d, once, cell, context, count, contexts

    def pack(self) -> bytes:
        pairs = np.bincount(self.cell, minlength=len(self.once))
        return _pack_cells(self.d.keys, self.once.astype(np.uint32), pairs.astype(np.uint32), self.context.astype(np.uint32),
                           self.count.astype(np.uint32), np.array([self.contexts]))

    @staticmethod
    def unpack(data: bytes) -> Bucket:
        keys, once, pairs, context, count, contexts = _unpack_cells(data)
        once, cell = once.astype(np.int64), np.repeat(np.arange(len(pairs)), pairs)
        return Bucket(Dishes(keys, once + pairs), once, cell, context.astype(np.int64), count.astype(np.int64), int(contexts[0]))

    def served(self, tables: np.ndarray) -> np.ndarray:
        """Customers of each cell: the tables that its pairs have."""
        return self.once + np.bincount(self.cell, weights=tables, minlength=len(self.once)).astype(np.int64)

    def sent(self, tables: np.ndarray) -> np.ndarray:
        """Tables by context, of pairs seen more than once."""
        return np.bincount(self.context, weights=tables, minlength=self.contexts).astype(np.int64)


def _sweep_pairs(b: Bucket, t: Totals, tables: np.ndarray, seats: list[Seating] | None, steps: int, rng) -> list[Seating]:
    """One Gibbs sweep of a bucket from the contexts up; ``tables`` are those of its contexts in all buckets."""
    d = b.d
    if seats is None:
        n1 = np.bincount(d.up, minlength=len(d.up_word))
        n0 = np.bincount(d.up_word, minlength=len(d.words))
        _, up = d.predict(t, n0, np.minimum(n0, 1), n1, np.minimum(n1, 1))
        n2, t2 = d.counts, np.ones(len(d.counts))
    else:
        pairs, low, mid, top = seats
        _, up = d.predict(t, top.customers, top.tables, mid.customers, mid.tables)
        n2, t2 = low.customers, low.tables
    new2 = t.new(2)[d.kind] * up[d.up]
    cell = (n2 - t.discounts[2] * t2 + new2) / t.room(2)[d.kind]
    new3 = (t.strengths[3] + t.discounts[3] * tables[b.context]) * cell[b.cell]
    if seats is None:
        pairs = first_seating(b.count, new3, t.discounts[3], rng)
        d.counts = b.served(pairs.tables)
        return [pairs, *_sweep(d, t, None, steps, rng)]
    pairs.move(new3, t.discounts[3], steps, rng)
    low.follow(b.served(pairs.tables), new2, t.discounts[2], rng)
    return [pairs, *_sweep(d, t, [low, mid, top], steps, rng)]


STATE = "kind string, bucket int, idx int, value double, data binary"


MERGED = "kind string, bucket int, idx int, value double, batch string, data binary"


def _sums(prefix: str, values: np.ndarray) -> list[tuple]:
    return [(prefix, -1, int(i), float(values[i]), None) for i in np.flatnonzero(values)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])


def _merge(group: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """The rows of ``_merged`` in one frame."""
    return pd.concat(_merged(iter([group]), buckets))


def _merged(groups: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """``_merge_rows`` of a bucket that comes in several frames, in frames of bounded size."""
    for some in _in_pieces(_merge_rows(groups, buckets)):
        yield pd.DataFrame(some, columns=[c.split()[0] for c in MERGED.split(", ")])


def _merge_rows(groups: Iterator[pd.DataFrame], buckets: int) -> Iterator[tuple]:
    """A bucket's pairs with their counts, the pairs of each batch, and the bucket's part of the totals.

    Rows: ``all`` (every pair with its count, learned or not), ``cells`` (a ``Bucket``), ``wants`` (by batch, numbers of its
    pairs), ``link`` (to the place of a context: customers, tables of pairs seen once, number of other pairs).
    """
    batches, read = [], []
    for group in groups:
        mine = int(group["bucket"].iloc[0])
        batches += list(group["batch"])
        read += [_unpack_pairs(x) for x in group["data"]]
    cut = np.cumsum([0] + [len(p[0]) for p in read])
    keys, context, learned = (np.concatenate(p) for p in _columns(read))
    order = np.lexsort((context, keys))
    keys = keys[order]
    context = context[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (context[1:] != context[:-1])])
    number = np.empty(len(keys), dtype=np.uint32)
    number[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    del order
    keys, context = keys[new], context[new]
    count = np.bincount(number, weights=learned).astype(np.int64)
    del learned, new
    yield "all", mine, 0, 0.0, None, _pack_pairs(keys, count.astype(np.uint32))
    for name, x, y in zip(batches, cut, cut[1:]):
        yield "wants", mine, 0, 0.0, name, pack(_steps(number[x:y]))
    del number
    keys, context, count = keys[count > 0], context[count > 0], count[count > 0]
    words, word, kind = _split(keys)
    first, of_cell = _runs(keys)
    cell = np.repeat(np.arange(len(first)), of_cell)
    many = count > 1
    once = np.bincount(cell[~many], minlength=len(first))
    names, at = np.unique(context[many], return_inverse=True)
    ranks = word[first].astype(np.uint64) << np.uint64(CLASS_BITS) | kind[first].astype(np.uint64)  # words by number
    types = len(words)
    del words, word, kind, keys
    d = Dishes(ranks, of_cell)
    yield "cells", mine, 0, 0.0, None, Bucket(d, once, cell[many], at, count[many], len(names)).pack()
    del cell, once, at
    names, at = np.unique(context, return_inverse=True)
    sums = [np.bincount(at, weights=x, minlength=len(names)).astype(np.uint32) for x in (count, ~many, many)]
    place = _context_bucket(names, buckets) // _width(buckets)
    cut = np.searchsorted(place, np.arange(buckets + 1))
    for k, (x, y) in enumerate(zip(cut, cut[1:])):
        if x < y:
            yield "link", k, mine, 0.0, None, pack(_steps(names[x:y]), *[z[x:y] for z in sums])
    n1, n0 = np.bincount(d.up, minlength=len(d.up_word)), np.bincount(d.up_word, minlength=len(d.words))
    counts = [int((y == k).sum()) for y in (n0, n1, of_cell, count) for k in (1, 2)]
    more = _sums("once", np.array(counts)) + _sums("size", np.array([count.sum(), types]))
    more += _sums("types2", np.bincount(d.kind, minlength=CLASSES))
    more += _sums("types1", np.bincount(d.up_kind, minlength=PARENTS))
    more += _sums("customers2", np.bincount(d.kind, weights=of_cell, minlength=CLASSES))
    for r in more:
        yield *r[:4], None, r[4]


def _places(group: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Contexts of a place (tables of pairs seen once, how many in which bucket) and what the buckets have of them.

    ``named`` holds the contexts that are words of a bucket and their customers, ``list`` holds the numbers of the contexts that a bucket has in pairs seen more than once, ``ask`` a table for each pair.
    """
    mine = int(group["bucket"].iloc[0])
    links = [unpack(x) for x in group["data"]]
    steps, customers, once, many = zip(*links)
    names, at = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in steps]), return_inverse=True)
    customers, once = (np.bincount(at, weights=np.concatenate(x), minlength=len(names)).astype(np.int64)
                       for x in (customers, once))
    of = _context_bucket(names, buckets)
    cut, size = _runs(of)
    rows = [("place", mine, 0, 0.0, pack(once, of[cut], size, names[:1]))]
    rows += [("named", int(of[a]), 0, 0.0, pack(_steps(names[a: a + n]), customers[a: a + n])) for a, n in zip(cut, size)]
    if names[0] == 0:
        rows += _sums("start", customers[:1])
    first = 0
    for bucket, own in zip(group["idx"], many):
        number = at[first: first + len(own)][own > 0]
        first += len(own)
        if len(number):
            rows.append(("list", mine, int(bucket), 0.0, pack(_steps(number.astype(np.uint32)))))
            rows.append(("ask", mine, int(bucket), 0.0, pack(own[own > 0])))
    return _frame(rows)


SUMS = {"customers2": CLASSES, "tables2": CLASSES, "customers1": PARENTS, "tables1": PARENTS, "root": 2}


def _context_totals(group: pd.DataFrame) -> pd.DataFrame:
    """Tables of the contexts that are words of a bucket (``context``), and of those that it has in pairs (``weight``).

    A place also adds up the ``sums`` of classes and root that some buckets send, one packed row each.
    """
    mine = int(group["bucket"].iloc[0])
    of = {kind: dict(zip(x["idx"], x["data"])) for kind, x in group.groupby("kind")}
    added = zip(*(unpack(x) for x in of.get("sums", {}).values()))
    classes = [row for name, x in zip(SUMS, added) for row in _sums(name, sum(x))]
    if "place" not in of:
        return _frame(classes)
    tables, buckets, size, least = unpack(of["place"][0])
    numbers = {k: np.cumsum(unpack(x)[0], dtype=np.int64) for k, x in of.get("list", {}).items()}
    for k, number in numbers.items():
        tables[number] += unpack(of["ask"][k])[0]  # a bucket has a context once
    stop = np.cumsum(size)
    rows = classes + [("context", int(k), 0, 0.0, pack(tables[b - n: b])) for k, b, n in zip(buckets, stop, size)]
    if least[0] == 0:
        rows += _sums("start", tables[:1])
    rows += [("weight", int(k), mine, 0.0, pack(tables[number].astype(np.uint32))) for k, number in numbers.items()]
    return _frame(rows)


def _collected(rows: DataFrame, names: dict[str, int]) -> dict[str, np.ndarray]:
    """Totals by name: at most a few hundred numbers."""
    out = {k: np.zeros(n) for k, n in names.items()}
    for r in rows.where(F.col("kind").isin(*names)).groupBy("kind", "idx").agg(F.sum("value").alias("v")).collect():
        out[r["kind"]][r["idx"]] = r["v"]
    return out


def _discount(once: float, twice: float) -> float:
    """Share of single occurrences that a discount should explain (counts of counts)."""
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once + twice else 0.5


def learn(merged: DataFrame, burn: int, samples: int, steps: int, seed: int, buckets: int) -> tuple[DataFrame, DataFrame, list[Totals], Totals]:
    """(pairs of each batch, model by bucket, totals of each sample, corpus totals).

    Every sweep reads the written state of the one before and writes its own; the older one is deleted.
    """
    spark = merged.sparkSession
    links = merged.where("kind = 'link'").select("bucket", "idx", "data")
    places = stage(links.groupBy("bucket").applyInPandas(lambda x: _places(x, buckets), STATE), "lm_places")
    got = _collected(merged.drop("batch").union(places), {
        "once": 8, "size": 2, "types2": CLASSES, "types1": PARENTS, "customers2": CLASSES, "start": 1})
    n, v = int(got["size"][0]), int(got["size"][1])
    discounts = [_discount(*got["once"][2 * k: 2 * k + 2]) for k in range(4)]
    # before the first seating: as if every dish had one table in each restaurant that serves it
    middle = np.bincount(_parent(np.arange(CLASSES)), weights=got["types2"], minlength=PARENTS)
    totals = Totals([np.array([got["types1"].sum()]), middle, got["customers2"]],
                    [np.array([float(v)]), got["types1"], got["types2"]], n, v, discounts, [1.0] * 4)
    corpus, began = totals, got["start"][0]
    fixed = places.where("kind in ('place', 'list')")
    own = merged.where("kind = 'cells'").select("kind", "bucket", "idx", "value", "data")

    def totals_of(asks: DataFrame) -> DataFrame:
        return stage(fixed.union(asks).groupBy("bucket").applyInPandas(_context_totals, STATE), "lm_contexts")

    contexts = totals_of(places.where("kind = 'ask'"))
    state, kept, every = None, [], []
    for k in range(1 + burn + samples):
        given = spark.sparkContext.broadcast(totals)
        sampled = k > burn

        def run(group: pd.DataFrame) -> pd.DataFrame:
            bucket = int(group["bucket"].iloc[0])
            of = {kind: x for kind, x in group.groupby("kind")}
            b, t = Bucket.unpack(of["cells"]["data"].iloc[0]), given.value
            if not len(b.d.keys):
                return _frame([])
            weights = of["weight"].sort_values("idx")["data"] if "weight" in of else []
            tables = np.concatenate([np.zeros(0), *(unpack(x)[0] for x in weights)])
            rng, seats = np.random.default_rng([seed, k, bucket]), None
            if "seats" in of:
                x = unpack(of["seats"]["data"].iloc[0])
                seats = [Seating(np.repeat(np.arange(len(c)), c), z.astype(np.int64), len(c)) for c, z in zip(x[::2], x[1::2])]
            seats = _sweep_pairs(b, t, tables, seats, steps, rng)
            pairs, low, mid, top = seats
            rows = [("seats", bucket, 0, 0.0, pack(*[a for z in seats
                                                     for a in (z.tables.astype(np.uint32), z.size.astype(np.uint32))]))]
            if sampled:
                counts = (pairs.tables, low.customers, low.tables, mid.customers, mid.tables, top.customers, top.tables)
                rows.append(("sample", bucket, k, 0.0, pack(*[c.astype(np.uint32) for c in counts])))
            sent, first = b.sent(pairs.tables).astype(np.uint32), 0
            if "weight" in of:  # in the order of the contexts, as their tables came
                for place, x in zip(of["weight"]["idx"].sort_values(), weights):
                    size = len(unpack(x)[0])
                    rows.append(("ask", int(place), bucket, 0.0, pack(sent[first: first + size])))
                    first += size
            d = b.d
            rows.append(("sums", bucket // _width(buckets), bucket, 0.0, pack(
                np.bincount(d.kind, weights=low.customers, minlength=CLASSES),
                np.bincount(d.kind, weights=low.tables, minlength=CLASSES),
                np.bincount(d.up_kind, weights=mid.customers, minlength=PARENTS),
                np.bincount(d.up_kind, weights=mid.tables, minlength=PARENTS),
                np.array([top.customers.sum(), top.tables.sum()], dtype=float))))
            return _frame(rows)

        source = own.union(contexts.where("kind = 'weight'"))
        if state:
            source = source.union(spark.read.parquet(state).where("kind = 'seats'"))
        path = fresh_path(spark, "lm_seats")
        source.groupBy("bucket").applyInPandas(run, STATE).write.parquet(path)
        done = spark.read.parquet(path)
        contexts = totals_of(done.where("kind in ('ask', 'sums')"))
        got = _collected(contexts, SUMS | {"start": 1})
        totals = Totals([got["root"][:1], got["customers1"], got["customers2"]],
                        [got["root"][1:], got["tables1"], got["tables2"]], n, v, discounts, corpus.strengths,
                        (began, got["start"][0]))
        if sampled:
            kept.append(stage(done.where("kind = 'sample'"), "lm_sample"))
            kept.append(contexts.where("kind = 'context'").withColumn("idx", F.lit(k)))
            every.append(totals)
        if state:
            drop_path(spark, state)
        state = path
    drop_path(spark, state)
    model = places.where("kind = 'named'").union(
        merged.where("kind = 'all'").select("kind", "bucket", "idx", "value", "data"))
    for x in kept:
        model = model.union(x)
    return merged.where("kind = 'wants'").select("batch", "bucket", "data"), model, every, corpus


def _answer(every: list[Totals], requests: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """For the pairs of every batch what the sampled restaurants know of them.

    By pair: the mean over the samples of customers less discounts.  By cell: the class's probability in each sample.  By
    word: its count, and as a context its customers and its tables in each sample.
    """
    by = {(kind, k): data for kind, k, data in zip(model["kind"], model["idx"], model["data"])}
    keys, count = _unpack_pairs(by["all", 0])
    count = count.astype(np.int64)
    first, n = _runs(keys)
    cell_of = np.repeat(np.arange(len(first)), n)
    cells = keys[first]
    customers = np.bincount(cell_of, weights=count, minlength=len(cells)).astype(np.int64)
    words, word, kind = _split(cells)
    total = np.bincount(word, weights=customers, minlength=len(words)).astype(np.int64)
    learned = customers > 0
    d = Dishes(cells[learned], customers[learned])
    samples = sorted(k for name, k in by if name == "sample")
    own, in_class = np.zeros(len(keys)), []
    known = np.cumsum(total > 0) - 1  # number among the learned words
    up_key, many = d.up_word * PARENTS + d.up_kind, count > 1
    for t, k in zip(every, samples or [None] * len(every)):
        if k is None:
            in_class.append(t.unseen()[kind])
            continue
        t3, n2, t2, n1, t1, n0, t0 = (a.astype(np.int64) for a in unpack(by["sample", k]))
        tables = (count > 0).astype(np.int64)
        tables[many] = t3
        own += count - t.discounts[3] * tables
        root, up = d.predict(t, n0, t0, n1, t1)
        root_w = np.where(total > 0, root[known], t.new(0)[0] * t.base / t.room(0)[0])
        parent = _parent(kind)
        want = known[word] * PARENTS + parent
        i = np.minimum(np.searchsorted(up_key, want), len(up_key) - 1)
        p1 = np.where((total > 0)[word] & (up_key[i] == want), up[i],
                      t.new(1)[parent] * root_w[word] / t.room(1)[parent])
        mine = np.zeros(len(cells))
        mine[learned] = n2 - t.discounts[2] * t2
        in_class.append((mine + t.new(2)[kind] * p1) / t.room(2)[kind])
    own = (own / max(len(every), 1)).astype(np.float32)
    in_class = [x.astype(np.float32) for x in in_class]
    as_context = [np.zeros(len(words), dtype=np.uint32) for _ in range(1 + len(every))]
    if ("named", 0) in by:
        names, sat = unpack(by["named", 0])
        names, mine = np.cumsum(names, dtype=np.uint64), context_of(words)
        i = np.minimum(np.searchsorted(names, mine), len(names) - 1)
        as_context = [np.where(names[i] == mine, x[i], 0).astype(np.uint32)
                      for x in (sat, *(unpack(by["context", k])[0] for k in samples))]
    rows = []
    for batch, data in zip(requests["batch"], requests["data"]):
        pair = np.cumsum(unpack(data)[0], dtype=np.int64)
        of = cell_of[pair]
        first, pairs = _runs(of)
        cell = of[first]
        first, ncells = _runs(word[cell])
        w = word[cell][first]
        rows.append((batch, int(requests["bucket"].iloc[0]), pack(
            own[pair], pairs.astype(np.uint32), *(x[cell] for x in in_class), ncells.astype(np.uint16),
            total[w].astype(np.uint64), *(x[w] for x in as_context))))
    return pd.DataFrame(rows, columns=["batch", "bucket", "data"])


SCORE = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
         "score double")


def _some(n: np.ndarray, at_once: int = 250_000) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first token, last, ends of its documents in it) of runs of documents of about ``at_once`` tokens."""
    stop = np.cumsum(n.astype(np.int64))
    doc, first = 0, 0
    while doc < len(n):
        last = max(doc + 1, int(np.searchsorted(stop, first + at_once, "right")))
        yield first, int(stop[last - 1]), stop[doc:last] - first
        doc, first = last, int(stop[last - 1])


def _score(every: list[Totals], corpus: Totals, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Sums of a batch's documents over the answers to its pairs, put together in the order of the buckets."""
    parts = list(answers.sort_values("bucket")["data"])  # unpacked one at a time, which bounds a worker's memory
    k, discount, strength = len(every), corpus.discounts[3], corpus.strengths[3]
    word, by_word, words = [], [], 0
    for x in parts:
        got = unpack(x)
        cells = got[2 + k].astype(np.int64)
        pairs = np.add.reduceat(got[1].astype(np.int64), np.cumsum(cells) - cells)
        word.append(np.repeat(np.arange(words, words + len(cells), dtype=np.int32), pairs))
        by_word.append(got[3 + k:])
        words += len(cells)
    word = np.concatenate(word)
    count, sat, *tables = (np.concatenate(x).astype(float) for x in zip(*by_word))
    # the start of a text is one more context
    sat = np.append(sat, every[0].start[0] if every else 0.0)
    tables = [np.append(x, t.start[1]) for x, t in zip(tables, every)]
    base = np.log10((count + 0.5) / (corpus.n + 0.5 * (corpus.v + 1)))
    context = np.zeros(len(word), dtype=np.int32)
    for data in docs["data"]:
        at, n, *_ = unpack(data)
        for first, last, stop in _some(n):
            before = np.full(last - first, words, dtype=np.int32)
            before[1:] = word[at[first: last - 1]]
            before[np.concatenate([[0], stop[:-1]]).astype(np.int64)] = words
            context[at[first:last]] = before  # the same for every token of a pair
    mine, first = np.empty(len(word)), 0
    for x in parts:
        own, pairs, *got = unpack(x)
        c = context[first: first + len(own)]
        up = sum((strength + discount * t[c]) * np.repeat(p, pairs) for t, p in zip(tables, got[:k])) / max(k, 1)
        mine[first: first + len(own)] = np.log10((own.astype(float) + up) / (strength + sat[c]))
        first += len(own)
    out = []
    for data in docs["data"]:
        at, n, ids, null, held = unpack(data)
        sums = [[], [], []]
        for first, last, stop in _some(n):
            own = at[first:last]
            start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
            for into, x in zip(sums, (count[word[own]] > 0, base[word[own]], mine[own])):
                into.append(np.add.reduceat(x.astype(float), start))
        sums = [np.concatenate(x) if x else np.zeros(0) for x in sums]
        out.append(pd.DataFrame({
            "doc_id": pd.array(np.where(null, None, ids), dtype="Int64"), "held_out": held, "n_tokens": n.astype(np.int64),
            "n_known": np.rint(sums[0]).astype(np.int64), "train_tokens": corpus.n, "base_score": sums[1],
            "score": sums[2]}))
    return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in SCORE.split(", ")])


def score(docs: DataFrame, folds: int = 5, held: int = 1, burn: int = 2, samples: int = 2, steps: int = 1,
          seed: int = 13, buckets: int | None = None, at_once: int = 16_000_000) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 22))  # rows of packed numbers are large
    buckets = buckets or parts(spark)
    doc_id = F.col("doc_id").cast("long")
    held_out = F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == held, F.lit(False))
    rows = texts_of(docs, doc_id.alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    path = fresh_path(spark, "lm_read")
    _read(rows, buckets, at_once, 500_000).write.partitionBy("kind").parquet(path)
    read = spark.read.schema(READ).parquet(path)
    cells = read.where("kind = 'cells'").select("bucket", "batch", "data")

    def merge(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _merged(groups, buckets)

    merged = stage(cells.groupBy("bucket").applyInPandas(merge, MERGED), "lm_cells")
    drop_path(spark, f"{path}/kind=cells")  # half of what is written, and read once
    wants, model, every, corpus = learn(merged, burn, samples, steps, seed, buckets)
    shared = spark.sparkContext.broadcast((every, corpus))
    answers = wants.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInPandas(
        lambda a, b: _answer(shared.value[0], a, b), "batch string, bucket int, data binary")
    texts = read.where("kind = 'docs'").select("batch", "data")
    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(
        lambda a, b: _score(*shared.value, a, b), SCORE)
