"""I-Match: edited texts against Python, equal texts, likeness, order of documents over ranges."""

import hashlib
import re

import pytest

from quillmark.llm import imatch
from tests.llm.conftest import prose


def near(rows):
    out = []
    for k, (i, t) in enumerate(rows):
        t, follow = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + follow[:half]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_edited_texts(make, ranges):
    rows = [(3 * i, prose(i, 3 + 7 * i)) for i in range(50)] + [(200, None), (201, ""), (202, "é🙂x"), (203, "x" * 3000)]
    got = imatch.fingerprints(make(list(reversed(rows))), ranges=ranges).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == near(rows)


def test_likeness(make):
    base = [(i, prose(i, 400)) for i in range(60)]
    rows = base + [(100 + i, t) for i, t in base[:10]] + [(200 + i, t + " extra") for i, t in base[:20]]
    got = {r.doc_id: r for r in imatch.fingerprints(make(rows), idf_low=0.0, idf_high=20.0).collect()}
    assert all(got[i].fingerprint == got[100 + i].fingerprint for i in range(10))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    close = [got[i].near_edited for i in range(60)]
    far = [got[i].near_next for i in range(59)]
    assert sum(close) / len(close) > 0.2 > 0.1 > sum(far) / len(far)
    assert len({r.fingerprint for r in got.values()}) == 80


def test_likeness_of_long_texts(make):
    rows = [(i, prose(i, 10_000 + 500 * i)) for i in range(21)]
    got = imatch.fingerprints(make(rows), idf_low=0.0, idf_high=20.0).collect()
    close, far = [r.near_edited for r in got], [r.near_next for r in got]
    assert sum(close) / len(close) > 0.25 > 0.15 > sum(far) / len(far)


def test_rows_follow_by_id_then_hash(make, awkward):
    rows = [r for r in awkward if len(r[1] or "") < 6000]
    got = imatch.fingerprints(make(rows), ranges=4).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t in rows)


def test_band_is_over_all_documents(spark, make):
    rows = [(i, f"common word{i % 5} only{i}") for i in range(100)]
    bits = 12
    (found,) = imatch.band(make(rows, extra=False), 0.5, 3.5, bits).first()
    assert len(found) == 1 << (bits - 6)
    assert sum(int(x & (2**64 - 1)).bit_count() for x in found) == 5  # df 20 of 100 lies inside, 100 and 1 do not


def test_single_row_and_empty_table(make):
    (r,) = imatch.fingerprints(make([(5, "one two three")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"one two" + b"one tw").hexdigest() and r.near_next == 1.0
    assert imatch.fingerprints(make([(1, "a")]).limit(0)).count() == 0


def test_no_python_in_the_plan(make):
    plan = imatch.fingerprints(make([(i, prose(i, 30)) for i in range(9)]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
