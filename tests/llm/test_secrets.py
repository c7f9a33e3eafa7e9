"""Secret scan: places against a Python scan, planted secrets found, look-alikes left, redaction."""

import random
import re
import time

from quillmark.llm import secrets
from tests.llm.conftest import prose

RUN = re.compile(secrets.CANDIDATE)


def hexes(r, n):
    return "".join(r.choice("0123456789abcdef") for _ in range(n))


def corpus():
    r = random.Random(5)
    rows, secret = [], {}
    for i in range(120):
        text = prose(i, 60)
        if i % 6 == 0:
            secret[i] = hexes(r, 40)
            text += f' token = "{secret[i]}" {prose(500 + i, 10)}'
        elif i % 6 == 1:
            secret[i] = hexes(r, 18)
            text += f" ñé password={secret[i]} {prose(500 + i, 10)}"
        elif i % 6 == 2:
            secret[i] = "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
            text += f" {secret[i]} {prose(500 + i, 10)}"
        elif i % 6 == 3:
            text += f" {r.randrange(10**15, 10**16)} 97.51.17.{i} 192.168.100.{i} someone.{i}@mail7.example.com"
        elif i % 6 == 4:
            text += f" https://www.example.com/a/b/{i}/index.html?page=12 {'ab' * 15} {prose(i, 3).replace(' ', '')}"
        rows.append((i, text))
    return rows, secret


def test_planted_secrets(make):
    rows, secret = corpus()
    got = secrets.scan(make(rows)).collect()
    found = {(r.doc_id, r.value) for r in got if r.is_secret}
    assert found == set(secret.items())
    assert all(0 <= r.score <= 1 for r in got)
    texts = dict(rows)
    for r in got:
        assert texts[r.doc_id][r.start: r.start + len(r.value)] == r.value
    clean = secrets.redact(make(rows)).collect()
    assert len(clean) == len(rows)
    for r in clean:
        assert r.text == (texts[r.doc_id].replace(secret[r.doc_id], "[SECRET]") if r.doc_id in secret else texts[r.doc_id])


def test_candidates_equal_a_python_scan(make, awkward):
    rows = awkward + corpus()[0] + [(502, 'password = "x" token:y'), (500, "a1" * 40 + " x=" + "b2" * 9 + "." + " é" + "c3" * 8), (501, "key=" + "9f" * 10)]
    got = secrets.candidates(make(rows)).collect()
    assert len(got) == sum(len(RUN.findall(t or "")) for _, t in rows)
    for r in got:
        if r.doc_id is not None and [i for i, _ in rows].count(r.doc_id) == 1:
            text = dict(rows)[r.doc_id]
            assert text[r.start: r.start + len(r.value)] == r.value
            assert (text[: r.start]).endswith(r.before) and text[r.start + len(r.value):].lstrip(".:=").startswith(
                r.after[:5].lstrip(".:="))


def test_assigned_values_of_any_length(make):
    rows, secret = corpus()
    short = {900: ('password = "hunter2x"', "hunter2x"), 901: ('{"pwd": "S3cr3tP4s", "n": 1}', "S3cr3tP4s"),
             902: ("secret: correcthorse", "correcthorse"), 903: ("password=Tr0ub4dor!x$9%kk and more", "Tr0ub4dor!x$9%kk"),
             904: ("export DB_PASSWORD='p w;d'", "p w;d")}
    prose_rows = [(950, f"{prose(1, 30)} the secretary and the author: nothing more {prose(2, 9)}")]
    rows = rows + [(i, f"{prose(i, 20)} {t} {prose(i + 1, 9)}") for i, (t, _) in short.items()] + prose_rows
    got = secrets.scan(make(rows)).collect()
    assert {(r.doc_id, r.value) for r in got if r.is_secret and r.doc_id >= 900} == {(i, v) for i, (_, v) in short.items()}
    assert {(r.doc_id, r.value) for r in got if r.is_secret and r.doc_id < 900} == set(secret.items())
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start: r.start + len(r.value)] == r.value for r in got)


def test_many_candidates_in_one_text(make):
    """Time grows with the text: 50,000 candidates in one."""
    text = " ".join(f"k{i:06d}abcdef{i % 97}" for i in range(50_000))
    begin = time.time()
    got = secrets.candidates(make([(1, text)])).agg({"start": "max", "*": "count"}).first()
    assert got["count(1)"] == 50_000 and got["max(start)"] == text.rindex(" ") + 1
    assert time.time() - begin < 60


def test_hand_labels_decide(spark, make):
    """The same format labelled as harmless is removed."""
    r = random.Random(9)
    rows, labels = [], []
    for i in range(80):
        value = hexes(r, 32)
        name = "secret" if i % 2 else "commit"
        text = f"{prose(i, 12)} {name} {value} {prose(900 + i, 8)}"
        rows.append((i, text))
        if i < 60:
            labels.append((i, text.index(value), i % 2))
    got = secrets.scan(make(rows), spark.createDataFrame(labels, "doc_id long, start long, label int")).collect()
    held = [x for x in got if x.doc_id >= 60 and len(x.value) == 32]
    assert len(held) == 20 and all(x.is_secret == bool(x.doc_id % 2) for x in held)


def test_without_labels_of_both_kinds(make):
    got = secrets.scan(make([(1, 'token = "0123456789abcdef0123"'), (2, None), (None, "")])).collect()
    assert [(r.doc_id, r.score, r.is_secret) for r in got] == [(1, 1.0, True)]


def test_no_python_in_the_plan(make):
    df = secrets.scan(make(corpus()[0]))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_awkward_rows_and_empty_table(make, awkward):
    docs = make(awkward)
    assert secrets.redact(docs).count() == len(awkward)
    assert secrets.redact(docs).columns == docs.columns
    assert secrets.scan(docs.limit(0)).count() == 0
    assert secrets.redact(docs.limit(0)).count() == 0
