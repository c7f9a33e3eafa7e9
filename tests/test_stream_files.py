"""Message files follow the text, batches stay."""

import os

from quillmark.plans import arrivals as ar
from quillmark.plans import dataset as dp
from quillmark.plans import lang as lp
from quillmark.session import run_folder
from quillmark.streaming import labels


def test_more_files_same_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(ar, "FILE_BYTES", 40_000)
    cols = ["id", "symbol", "next_day", "label"]
    got = sorted(map(tuple, ar.q_stream_labels(spark, sf).select(cols).collect()))
    assert got and got == sorted(map(tuple, dp.q_ground_truth(spark, sf).select(cols).collect()))


def test_messages_are_written_once(spark, sf, monkeypatch):
    monkeypatch.setattr(ar, "FILE_BYTES", 60_000)
    calls, run = [], labels.run
    monkeypatch.setattr(labels, "run", lambda *a, **k: calls.append(run(*a, **k)))
    ar.q_stream_labels(spark, sf)
    assert not [x for x in os.listdir(run_folder(spark).removeprefix("file:")) if x.startswith("stream_messages")]
    assert len(calls) == 3 and 1 < calls[0] <= 3 and 1 < calls[1] <= 3 and calls[2] == 0


def test_texts_join_last(spark, sf):
    for df in (dp.labelled(spark, sf), lp.q_labelled_table(spark, sf)):
        joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
        assert "doc_key" in joins[0] and not any("doc_key" in x for x in joins[1:])
