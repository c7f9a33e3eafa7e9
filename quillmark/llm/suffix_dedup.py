"""Suffix-array deduplication: removes every byte covered by a 400-byte string that also starts elsewhere.

Windows are the strings of ``window`` bytes of a text.  Each window has one
anchor: the position of its ``core``-byte string with the smallest hash (the last such
position), so equal windows have equal anchors at equal offsets.  The windows
of one anchor form a stretch of the text (at most ``2 * window - core`` bytes).

1. Every stretch becomes (anchor hash, stretch hash, document, place); equal
   stretches are counted before anything is shuffled.
2. An anchor hash met once holds no repeat.  A stretch met twice or more is
   repeated as a whole.  Only different stretches under one anchor hash need sorting.
3. These are cut into *slices*: the windows that start in one range of offsets from the anchor.  All of them hold the
   bytes from the range's last start to the end of its first window, the middle.  Equal windows lie in slices of equal
   middles, so a slice is filed under the hash of its middle and consists of few other bytes: those
   left and right of it.
4. Slices of one middle are sorted: each is a sequence of its left bytes, one symbol for the middle, its right bytes and
   an end of its own, and a window is a suffix's first ``range`` symbols.  The linear grouping construction
   (``gsaca``) sorts the suffixes, and a window repeats exactly if its suffix shares these symbols with a neighbour in the order.
5. A middle with more than ``crowd`` different slices is not sorted at once: its slices are halved.  The halves have longer
   middles, and a range of one start has the window itself as middle, so this ends with small groups whatever the texts.
6. The repeated windows become covered intervals, joined back to the texts.

Whole windows of the input are compared, never what is left of it, and matches do not
cross documents.

Defined cases: a null text is an empty one; texts shorter than the window keep
everything; texts of any length are cut into the same short stretches; repeated rows are copies of each other and lose
everything they can; a null ``doc_id`` is kept; extra columns are left out, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Rolling, texts_of
from quillmark.llm.gsaca import suffix_array
from quillmark.session import stage

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd multipliers of the rolling hashes
TIE_BITS = 24


_ROLLINGS: list[Rolling] = []


def rollings() -> list[Rolling]:
    """The worker's two rolling hashes."""
    if not _ROLLINGS:
        _ROLLINGS.extend(Rolling(b) for b in BASES)
    return _ROLLINGS


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: running minima of blocks from both ends."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, width)
    forth = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], forth[width - 1: n])


def stretches(data: np.ndarray, window: int, core: int, rolling: Rolling) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor, first window, last window) of the windows of a byte string, grouped by anchor."""
    h = rolling.windows(data, core)
    at = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << TIE_BITS) - 1)
    key = (h & ~low) | (low - (at & low))  # ties: the last position
    width = window - core + 1
    least = sliding_minimum(key, width)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(least)]]) - 1
    # the position behind a key: its low bits, counted from the first window of the stretch
    anchor = first + ((low - (least[first] & low) - first.astype(np.uint64)) & low).astype(np.int64)
    return h[anchor], anchor, first, last


SPAN = "anchor long, stretch long, rid long, at long, first int, last int"


def _spans(rows: DataFrame, window: int, core: int) -> DataFrame:
    """All stretches: anchor and stretch hash, row, place; first and last window start relative to the anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = rollings()[0]
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for rid, text in zip(b.column("rid").to_pylist(), b.column("text").to_pylist()):
                data = (text or "").encode()
                if len(data) < window:
                    continue
                h, at, first, last = stretches(np.frombuffer(data, dtype=np.uint8), window, core, rolling)
                mark = np.fromiter((digest(data[x: y + window], int(p)) for x, y, p in zip(
                    first.tolist(), last.tolist(), (at - first).tolist())), dtype=np.uint64, count=len(at))
                for o, v in zip(out, (h.view(np.int64), mark.view(np.int64), np.full(len(at), rid), at,
                                      (first - at).astype(np.int32), (last - at).astype(np.int32))):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out],
                                                 names=[c.split()[0] for c in SPAN.split(", ")])

    return rows.mapInArrow(run, SPAN)


def _counted(spans: DataFrame) -> DataFrame:
    """(anchor, stretch, n, rid, at, first, last): each different stretch with its count and one place that holds it.

    Batches are counted before the shuffle by anchor, so copies of a document cost a row a batch.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).group_by(["anchor", "stretch"], use_threads=False).aggregate(
                [("rid", "count"), *[(c, "first") for c in ("rid", "at", "first", "last")]])
            t = t.rename_columns([{"rid_count": "n"}.get(c, c.removesuffix("_first")) for c in t.column_names])
            yield from t.select(["anchor", "stretch", "n", "rid", "at", "first", "last"]).to_batches()

    some = spans.mapInArrow(count, "anchor long, stretch long, n long, rid long, at long, first int, last int")
    place = [F.first(c).alias(c) for c in ("rid", "at", "first", "last")]  # all from the same row
    return some.repartition("anchor").groupBy("anchor", "stretch").agg(F.sum("n").alias("n"), *place)


SLICE = "anchor long, stretch long, lo int, hi int, first int, last int, middle long, left binary, right binary"


def slices(data: bytes, first: int, last: int, window: int, core: int, span: int) -> Iterator[tuple]:
    """(lo, hi, first, last, middle, left, right) of a stretch whose windows start at first..last from the anchor.

    Its bytes begin at ``first``.  ``lo`` to ``hi`` is the range, ``first`` to ``last`` the stretch's own windows in it.
    """
    lo = -(window - core) + (first + window - core) // span * span
    while lo <= last:
        hi = lo + span - 1
        a, b = max(lo, first), min(hi, last)
        left, middle, right = (data[x - first: y - first] for x, y in ((a, hi), (hi, lo + window), (lo + window, b + window)))
        yield lo, hi, a, b, int(np.uint64(xxhash.xxh3_64_intdigest(middle)).astype(np.int64)), left, right
        lo += span


def _sliced(rows: DataFrame, wanted: DataFrame, window: int, core: int, span: int) -> DataFrame:
    """Slices of the wanted stretches, read from one row that holds each."""
    by_row = wanted.groupBy("rid").agg(F.collect_list(F.struct("anchor", "stretch", "at", "first", "last")).alias("w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, w in zip(b["text"], b["w"]):
                data = (text or "").encode()
                for x in w:
                    part = data[x["at"] + x["first"]: x["at"] + x["last"] + window]
                    out += [(x["anchor"], x["stretch"], *c) for c in slices(part, x["first"], x["last"], window, core, span)]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in SLICE.split(", ")])
                    out = []
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SLICE.split(", ")])

    return rows.join(by_row, "rid").select("text", "w").mapInPandas(run, SLICE)


def _halved(found: DataFrame, window: int) -> DataFrame:
    """The halves of slices that have windows of their own, filed under their longer middles."""
    lo, hi, a, b, left, right = (F.col(c) for c in ("lo", "hi", "first", "last", "left", "right"))
    mid = F.floor((lo + hi) / 2).cast("int")
    cut = F.octet_length(left) - (hi - mid)  # left bytes in front of the first half's middle
    more = mid + 1 - lo                      # right bytes that the second half's middle takes in

    def named(*own: Column) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip(own, ("lo", "hi", "first", "last", "middle", "left", "right"))])

    front = named(lo, mid, a, F.least(b, mid), F.xxhash64("middle", F.lit(0), F.substring(left, cut + 1, hi - mid)),
                  F.substring(left, F.lit(1), cut), F.substring(right, F.lit(1), F.least(b, mid) - lo))
    back = named(mid + 1, hi, F.greatest(a, mid + 1), b, F.xxhash64("middle", F.lit(1), F.substring(right, F.lit(1), more)),
                 F.substring(left, F.greatest(a, mid + 1) - a + 1, F.octet_length(left)), F.substring(right, more + 1, F.octet_length(right)))
    both = F.filter(F.array(F.when(a <= mid, front), F.when(b > mid, back)), lambda x: x.isNotNull())
    return found.select("anchor", "stretch", F.explode(both).alias("s")).select("anchor", "stretch", "s.*")


def repeats(group: pd.DataFrame) -> pd.DataFrame:
    """Windows of slices that another slice of the same group, middle and range holds, found by suffix sorting.

    ``group`` (group, lo, hi, first, last, left, right), one range width; returns (row, start) with ``row`` from 0.
    """
    width = group["hi"].to_numpy() - group["lo"].to_numpy() + 1
    out = []
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        some = group.iloc[rows]
        n = len(some)
        left, right = some["left"].tolist(), some["right"].tolist()
        before = np.array([len(x) for x in left])
        size = before + np.array([len(x) for x in right]) + 2
        stop = np.cumsum(size)
        begin = stop - size
        # symbols: an end of its own for each slice, then bytes, then one for each middle
        text = np.empty(stop[-1], dtype=np.int64)
        text[:] = np.frombuffer(b"".join(x + b"\0" + y + b"\0" for x, y in zip(left, right)), dtype=np.uint8)
        text += n
        text[begin + before] = n + 256 + some["group"].to_numpy()
        text[stop - 1] = np.arange(n)
        order = suffix_array(text)
        owner = np.repeat(np.arange(n), size)
        first, last = some["first"].to_numpy(), some["last"].to_numpy()
        start = np.arange(len(text)) - begin[owner] + first[owner]
        order = order[start[order] <= last[owner[order]]]  # the suffixes that are windows; neighbours stay neighbours
        held = np.lib.stride_tricks.sliding_window_view(text, int(w)) if len(text) >= w else np.empty((0, int(w)), np.int64)
        same = np.zeros(max(len(order) - 1, 0), dtype=bool)
        for k in range(0, len(same), 8192):
            same[k: k + 8192] = (held[order[k: k + 8192][: len(same) - k]] == held[order[k + 1: k + 8193]]).all(axis=1)
        near = np.zeros(len(order), dtype=bool)
        near[:-1] |= same
        near[1:] |= same
        hits = order[near]
        out.append(pd.DataFrame({"row": rows[owner[hits]], "start": start[hits]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"row": [], "start": []}, dtype=np.int64)


def _intervals(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Covered intervals of sorted window starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    lo = starts[np.concatenate([[0], cut + 1])]
    hi = starts[np.concatenate([cut, [len(starts) - 1]])] + window
    return list(zip(lo.tolist(), hi.tolist()))


FILED = ["anchor", "middle", "lo", "hi"]  # what equal windows' slices have in common
SPREAD = "anchor long, middle long, lo int, hi int, mark long, from array<int>, to array<int>"


def _sorted_verdicts(different: DataFrame, buckets: int, window: int) -> DataFrame:
    """Covered intervals (relative to the anchor) of different slices, found by suffix sorting bucket by bucket."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([*FILED, "mark"], ignore_index=True)
        group["group"] = group.groupby(FILED, sort=False).ngroup()
        found = repeats(group).sort_values(["row", "start"])
        rows, at = np.unique(found["row"].to_numpy(dtype=np.int64), return_index=True)
        if not len(rows):
            return pd.DataFrame(columns=[*FILED, "mark", "from", "to"], dtype=object)
        spans = [_intervals(x, window) for x in np.split(found["start"].to_numpy(dtype=np.int64), at[1:])]
        out = group.loc[rows, [*FILED, "mark"]].copy()
        out["from"], out["to"] = [[i[0] for i in s] for s in spans], [[i[1] for i in s] for s in spans]
        return out

    keyed = different.withColumn("bucket", F.pmod(F.xxhash64(*FILED), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInPandas(run, SPREAD)


def _verdicts(parts: DataFrame, window: int, crowd: int, bucket_slices: int) -> DataFrame:
    """(anchor, stretch, spans): covered intervals, relative to the anchor, of stretches that differ under one anchor."""
    pending, out = parts, []
    while True:
        pending = stage(pending.withColumn("mark", F.xxhash64("middle", "first", "last", "left", "right")), "suffix_slices")
        kinds = pending.groupBy(*FILED, "mark").agg(F.count("*").alias("n"), F.min(F.struct("first", "last", "left", "right")).alias("s"))
        kinds = stage(kinds, "suffix_kinds")
        per = kinds.groupBy(*FILED).agg(F.count("*").alias("different"), F.sum("n").alias("all")).where("all > 1")
        per = stage(per.withColumn("halve", (F.col("different") > crowd) & (F.col("hi") > F.col("lo"))), "suffix_middles")
        one = kinds.where("n > 1").select(*FILED, "mark", F.array("s.first").alias("from"), F.array(F.col("s.last") + window).alias("to"))
        sort = kinds.join(per.where("different > 1 and not halve").select(*FILED), FILED).select(*FILED, "mark", "s.*")
        sort = stage(sort, "suffix_different")
        found = one.unionByName(_sorted_verdicts(sort, max(1, -(-sort.count() // bucket_slices)), window))
        out.append(stage(pending.select(*FILED, "mark", "stretch").join(found, [*FILED, "mark"])
                         .select("anchor", "stretch", F.arrays_zip("from", "to").alias("spans")), "suffix_found"))
        if per.where("halve").isEmpty():
            break
        # what a slice met twice covers is known; its windows still serve as partners of others
        pending = _halved(pending.join(per.where("halve").select(*FILED), FILED), window)
    every = reduce(DataFrame.unionByName, out)
    return every.groupBy("anchor", "stretch").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def covered(docs: DataFrame, window: int = 400, core: int = 100, span: int = 43, crowd: int = 300,
            bucket_slices: int = 1000) -> DataFrame:
    """(rid, spans): byte intervals of repeated windows of each text, unsorted and overlapping."""
    rows = _rows(docs)
    spans = stage(_spans(rows, window, core), "suffix_spans")
    by_anchor = Window.partitionBy("anchor")
    counted = (_counted(spans).withColumn("total", F.sum("n").over(by_anchor))
               .withColumn("different", F.count("*").over(by_anchor)).where("total > 1"))
    counted = stage(counted, "suffix_repeats")
    whole = counted.where("n > 1").select(
        "anchor", "stretch", F.array(F.struct(F.col("first").alias("from"), (F.col("last") + window).alias("to"))).alias("spans"))
    mixed = counted.where("different > 1")
    parts = _sliced(rows, mixed.select("anchor", "stretch", "rid", "at", "first", "last"), window, core, span)
    verdicts = _verdicts(parts, window, crowd, bucket_slices).join(whole.select("anchor", "stretch"), ["anchor", "stretch"], "left_anti")
    verdicts = stage(verdicts.unionByName(whole), "suffix_verdicts")
    hits = spans.select("anchor", "stretch", "rid", "at").join(verdicts, ["anchor", "stretch"])
    placed = F.transform("spans", lambda x: F.struct((x["from"] + F.col("at")).alias("lo"), (x["to"] + F.col("at")).alias("hi")))
    return hits.select("rid", placed.alias("i")).groupBy("rid").agg(F.flatten(F.collect_set("i")).alias("spans"))


def _rows(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return texts_of(docs, doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("rid"), text.alias("text"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every document."""
    found = covered(docs, **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, spans in zip(b["text"], b["spans"]):
                data = (text or "").encode()
                cuts = _merged(spans) if spans is not None else []
                edges = [0, *[x for c in cuts for x in c], len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept))
            rows = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            rows.insert(0, "doc_id", b["doc_id"].array)
            yield rows

    rows = _rows(docs).join(found, "rid", "left").select("doc_id", "text", "spans")
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                 "kept binary")
