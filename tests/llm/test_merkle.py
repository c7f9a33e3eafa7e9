"""The manifest against a plain recursive reading of its definition."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillmark.llm import merkle
from tests.llm.conftest import prose


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fan):
    """(top, siblings left and right of each lowest node per level)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, range(len(ways))):
            k = at[i]
            first = k - k % fan
            way.append(("".join(nodes[first:k]), "".join(nodes[k + 1: first + fan])))
            at[i] = k // fan
        nodes = [H("".join(nodes[i: i + fan])) for i in range(0, len(nodes), fan)]
    return nodes[0], ways


def expected(rows, altered, fan):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops, inner = [], {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, inner[s] = climb([leaf(r) for r in by[s]], fan)
        tops.append(top)
    root, outer = climb(tops, fan)
    out = []
    for s, top, up in zip(order, tops, outer):
        for r, way in zip(by[s], inner[s]):
            digest = leaf(altered(r))
            for a, b in way + up:
                digest = H(a + digest + b)
            out.append((r[0], leaf(r), top, root, H("".join(a + b for a, b in way + up)), digest, digest == root))
    return out


def full(rows):
    return [(r[0], r[3] if len(r) > 3 else "s", r[2] if len(r) > 2 else "en", len(r[1] or ""), r[1]) for r in rows]


def key(r):
    return tuple((x is not None, x or 0) for x in r)


CASES = {
    "one row": [(1, "A")],
    "one source": [(i, prose(i, 5), "en", "s") for i in range(20)],
    "many sources": [(i, prose(i, 3).title(), "en", f"s{i % 19}") for i in range(120)],
    "a hot source": [(i % 70, "Abc" if i % 3 else prose(i, 4), "de", "hot" if i % 8 else None) for i in range(300)],
    "sources of one row": [(i, "x", None, chr(97 + i)) for i in range(18)] + [(50, "y", "en", "é"), (51, None, "en", "😀"), (52, "", "en", "￿")],
}


@pytest.mark.parametrize("name,fan,depth", [("one row", 16, 2), ("one source", 16, 1), ("many sources", 16, 2), ("many sources", 2, 1),
                                            ("a hot source", 3, 2), ("sources of one row", 16, 2)])
def test_equals_the_definition(make, name, fan, depth):
    docs = make(CASES[name]).repartition(3)
    hit = lambda i: i is not None and i % 5 == 0
    altered = {"text": F.when(F.col("doc_id") % 5 == 0, merkle.lowered(F.col("text"))).otherwise(F.col("text"))}
    got = [tuple(r) for r in merkle.manifest(docs, altered, fan, depth).collect()]
    want = expected(full(CASES[name]), lambda r: (*r[:4], r[4].lower() if hit(r[0]) and r[4] else r[4]), fan)
    assert sorted(got, key=key) == sorted(want, key=key)
    if name == "many sources":
        assert {r[-1] for r in got} == {True, False}


def test_awkward_rows(make, awkward):
    got = [tuple(r) for r in merkle.manifest(make(awkward), None, 2, 1).collect()]
    assert sorted(got, key=key) == sorted(expected(full(awkward), lambda r: r, 2), key=key)
    assert all(r[-1] for r in got)


def test_any_column_counts(make):
    docs = make([(i, "t", "en", "s") for i in range(40)])
    some = F.col("doc_id") % 2 == 0
    altered = {"lang": F.when(some, F.lit(None)).otherwise(F.col("lang")), "n_chars": F.col("n_chars") + F.when(~some, 1).otherwise(0)}
    assert not merkle.manifest(docs, altered).where("verified").count()


def test_empty_table(make):
    assert merkle.manifest(make([(1, "a")]).limit(0)).count() == 0
