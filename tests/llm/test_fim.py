"""Fill-in-middle against a plain reading of its definition, one text at a time."""

import hashlib
import re

import pytest

from quillmark.llm import fim
from tests.llm.conftest import prose

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def one(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) of a text, from the definition."""
    text = text or ""
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i: 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MARKED = ["<P>", "a <S> b", "<M", "<P", "<", "x<M>y", "<S><P>", "ends with <P", "> begins", "<p> <Q>", "M><S", "é<P", "ß<", "<\n>"]


@pytest.mark.parametrize("at_once", [4_000_000, 50, 1])
def test_equals_the_definition(make, awkward, at_once):
    rows = [*awkward, *((100 + i, t) for i, t in enumerate(MARKED)), *((500 + i, prose(i, i % 9) + "É.\r\n<") for i in range(120))]
    got = fim.restore(fim.transform(make(rows), at_once=at_once), at_once=at_once).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    want = sorted(((i, *one(i, t)) for i, t in rows), key=key)
    assert [tuple(r)[:6] for r in sorted(got, key=key)] == want
    assert {r["form"] for r in got} == set(fim.FORMS)
    texts = sorted(t or "" for _, t in rows)
    assert sorted(r["restored"] for r in got) == texts


def test_shares(make):
    got = fim.transform(make([(i, f"word {i}") for i in range(3000)])).groupBy("form").count().collect()
    n = {r["form"]: r["count"] for r in got}
    assert abs(n["plain"] - 300) < 80 and abs(n["spm"] - 540) < 100


def test_other_shares(make):
    got = fim.transform(make([(i, "a b c") for i in range(50)]), plain_percent=0, spm_percent=100).collect()
    assert {r["form"] for r in got} == {"spm"}


def test_restore_refuses_damage(spark):
    for output, form in (("<P>a<S>b", "psm"), ("<S>a<M>b<P>c", "spm"), ("abc", "psm"), ("<P><P><S><M>", "psm")):
        with pytest.raises(Exception, match="mark"):
            fim.restore(spark.createDataFrame([(output, form)], "output string, form string")).collect()
    kept = fim.restore(spark.createDataFrame([(None, None, 7)], "output string, form string, restored_from int")).collect()
    assert [tuple(r) for r in kept] == [(None, None, 7, "")]


def test_empty_table(make):
    assert fim.restore(fim.transform(make([(1, "a")]).limit(0))).count() == 0
