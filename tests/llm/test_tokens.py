"""Token ids, records and packing: exact against the library on whole texts, round trips, every constraint."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillmark.llm import packing, records, tokens
from quillmark.session import fresh_path
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.byte_bpe())


ODD = ["", " ", "  ", "a  b", " x", "x ", "x  ", "a\t \tb", "a\n b", "a \n\n b  ", "\n\n", "it's we're", "!\x1c ab é",
       "hi <|endoftext|> y", "x　y z   k", "a.b,c!!! d### e", "foo.\nBar\n\nbaz", "né. à,\n ç", "12 345 6a 7b8",
       "\x85 x", "a\x85b c", "😀 😀😀 é́", "tab\tx y", "a b c  d"]


def test_ids_equal_the_library(library):
    texts = [*ODD, None, prose(3, 5000), *(prose(i, 50) for i in range(40))]
    for limit in (400_000, 50):
        enc = tokens.Encoder(tokens.byte_bpe(), limit=limit)
        for _ in range(2):
            flat, count = enc(texts)
            for t, ids in zip(texts, np.split(flat, np.cumsum(count)[:-1])):
                assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_records_round_trip(spark, make, awkward, library):
    rows = awkward + [(100 + i, t) for i, t in enumerate(ODD)]
    folder = fresh_path(spark, "records-test")
    got = records.encode(make(rows), folder, files=3).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for i, t in order:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    key = lambda r: (r[1], r[2])
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    index = records.read_index(spark, folder)
    some = records.read_records(spark, folder, index.where("n_tokens > 3")).collect()
    assert sorted((r.doc_id or -1, len(r.ids), zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())) for r in some) == sorted(
        (i or -1, n, c) for i, _, n, c in want if n > 3)


def test_damage_is_found():
    good = records.frame(7, np.array([1, 2, 3]), 2) + b"\n"
    assert records.unframe(good, 0)[0] == 7
    for k in (0, 9, 15, len(good) - 3):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), 0)
    with pytest.raises(ValueError):
        records.unframe(good[:-4], 0)


def test_packing_is_exact(make, awkward, library):
    size = 64
    got = packing.pack_documents(make(awkward), size=size, shard_pieces=500).toPandas()
    lengths = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in awkward)
    assert got["length"].sum() == sum(lengths) and got["length"].max() <= size
    assert (got["piece"] == 0).sum() == len(awkward)
    assert (got.loc[got["piece"] > 0, "length"] == size).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= size
    ids = np.array(library.encode(awkward[9][1], add_special_tokens=False).ids + [0], dtype="<u4")
    mine = got[got.doc_id == 6].sort_values("piece")
    assert mine["start"].tolist() == [0, *mine["length"].cumsum()[:-1]]
    assert mine["ids_crc32"].tolist() == [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(mine["start"], mine["length"])]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 101, 400))[::-1]
    seq, off = packing.vector_best_fit(lengths, (100, 4, 6000), (1.0, 0.3, 0.3), rule)
    for s in np.unique(seq):
        x = lengths[seq == s]
        assert x.sum() <= 100 and len(x) <= 4 and (len(x) == 1 or (x * x).sum() <= 6000)
    with_limits = len(np.unique(seq))
    seq, _ = packing.vector_best_fit(lengths, (100, 100, 10_000), (1.0, 0.05, 0.05), rule)
    bound = int(np.ceil(lengths.sum() / 100))
    assert bound <= len(np.unique(seq)) <= with_limits
    if rule == "norm":
        assert len(np.unique(seq)) <= bound * 1.05 + 1


def test_empty_tables(spark, make):
    none = make([(1, "a")]).limit(0)
    assert packing.pack_documents(none).count() == 0
    assert records.encode(none, fresh_path(spark, "records-test")).count() == 0


def test_files_follow_the_bytes_and_wanted_rows_may_repeat(spark, make):
    rows = [(i, prose(i, 200)) for i in range(60)]
    folder = fresh_path(spark, "records-test")
    records.encode(make(rows), folder, file_bytes=3000)
    index = records.read_index(spark, folder)
    assert index.select("file").distinct().count() > records.parts(spark)
    wanted = index.where("doc_id % 3 = 0").selectExpr("*", "cast(doc_id AS string) AS mark")
    got = records.read_records(spark, folder, wanted.union(wanted)).collect()
    size = {r.doc_id: r.n_tokens for r in index.collect()}
    assert sorted(r.doc_id for r in got) == sorted(2 * [i for i in range(60) if i % 3 == 0])
    assert all(r.mark == str(r.doc_id) and len(r.ids) == size[r.doc_id] for r in got)
