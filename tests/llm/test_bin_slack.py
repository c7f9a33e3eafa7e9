"""Minimum bin slack: exact ids, no padding, and the subset-sum against all subsets."""

import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillmark.llm import bin_slack, tokens
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.byte_bpe())


def test_closest_equals_all_subsets():
    rng = np.random.default_rng(7)
    for _ in range(300):
        lengths = sorted(rng.choice(np.arange(1, 40), size=rng.integers(0, 5), replace=False).tolist(), reverse=True)
        counts = rng.integers(1, 4, len(lengths)).tolist()
        room = int(rng.integers(0, 80))
        used = bin_slack.closest(lengths, counts, room)
        every = [sum(n * x for n, x in zip(ns, lengths)) for ns in itertools.product(*(range(c + 1) for c in counts))]
        assert all(0 <= u <= c for u, c in zip(used, counts))
        assert sum(u * x for u, x in zip(used, lengths)) == max(s for s in every if s <= room)


def check(rows, got, library, size):
    """Every id of every document lies in one piece, sequences are gapless and need no padding."""
    docs = {}
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        docs.setdefault((i, len(ids)), []).append(ids)
    for (i, n), some in docs.items():
        mine = got[(got["doc_id"].isna() if i is None else got["doc_id"] == i) & (got["doc_tokens"] == n)]
        assert mine["length"].sum() == n * len(some)
        crcs = {zlib.crc32(x[a:b].tobytes()) for x in some for a, b in zip(mine["start"], mine["start"] + mine["length"])}
        assert set(mine["ids_crc32"]) <= crcs
        if len(some) == 1:
            mine = mine.sort_values("start")
            assert mine["start"].tolist() == [0, *mine["length"].cumsum()[:-1]]
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        total = int(g["length"].sum())
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]]
        assert total == size or total < size and total & (total - 1) == 0


@pytest.mark.parametrize("size,pool", [(64, 400), (2048, 5000), (16, 2_000_000), (1, 10)])
def test_packing(make, awkward, library, size, pool):
    rows = [r for r in awkward if size > 1 or len(r[1] or "") < 1000]
    rows = [*rows, *((200 + i, prose(i, 3 + i * 7 % 40)) for i in range(60))]
    packed = bin_slack.pack_documents(make(rows).repartition(2), size=size, pool=pool)
    got = packed.toPandas()
    check(rows, got, library, size)
    figures = bin_slack.padding(packed, size).first()
    assert figures["padding"] == 0 and figures["tokens"] == got["length"].sum()


def test_few_documents_are_cut(make):
    """Windows are filled by whole rests: far fewer cuts than by cutting wherever a window ends."""
    rows = [(i, prose(i, 5 + i * 13 % 120)) for i in range(600)]
    packed = bin_slack.pack_documents(make(rows).repartition(1), size=512)
    figures = bin_slack.padding(packed, 512).first()
    assert figures["padding"] == 0
    assert figures["cuts"] <= 0.1 * figures["sequences"] + 10


def test_the_same_again(make):
    rows = [(i, prose(i, 5 + i % 50)) for i in range(100)]
    packed = bin_slack.pack_documents(make(rows).repartition(3, "doc_id"), size=128)
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, packed.collect()))


def test_sizes_and_empty_tables(make):
    with pytest.raises(ValueError):
        bin_slack.pack_documents(make([(1, "a")]), size=100)
    assert bin_slack.pack_documents(make([(1, "a")]).limit(0)).count() == 0
