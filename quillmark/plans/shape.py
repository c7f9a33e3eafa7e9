"""Registered projection, renaming and union queries (B1, B6, B8, S1, S3, F7) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.numeric import round_sig, sql_round_sig
from quillmark.plans import dataset as dp
from quillmark.sources import tables

DIG = 8
# Label ids of the transformer scoring path (0 positive, 1 neutral, 2 negative).
LABEL2ID = {"positive": 0, "neutral": 1, "negative": 2}
# only the scan-based EWM columns differ in the last bits between engines; element-wise doubles are exact
DOUBLE_COLS = [f"ewm_{dp.K}", f"ewm_std_{dp.K}"]


def label_ids(c, mapping=LABEL2ID):
    """label name -> id through a literal map (the mapping is a parameter)."""
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])[c]


def _split(spark, sf) -> DataFrame:
    return dp.split_view(dp._views(spark, sf)["msg_all"], "msg_all")


def q_projection(spark, sf):
    """The fixed column list of the labelled table (derived columns included), EWM doubles rounded."""
    lab = dp.labelled(spark, sf)
    return lab.select(*[round_sig(F.col(c), DIG).alias(c) if c in DOUBLE_COLS else F.col(c)
                        for c in dp.LABELLED_COLS])


def q_label_ids(spark, sf):
    """Model input shape: ``title`` renamed to ``text``, label as id, all else dropped."""
    s = _split(spark, sf).join(tables.messages(spark, sf).select("id", "title"), "id")
    return s.select("id", F.col("title").alias("text"), label_ids(F.col("label")).alias("labels"), "split")


def q_train_val_union(spark, sf):
    """Train and val of one dataset unioned by name for fitting."""
    s = _split(spark, sf).select("id", "label", "split")
    return s.where(F.col("split") == "train").unionByName(s.where(F.col("split") == "val"))


QUERIES = {
    "q_projection": q_projection,
    "q_label_ids": q_label_ids,
    "q_train_val_union": q_train_val_union,
}

_CASE = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LABEL2ID.items()) + " END"

ORACLE = {
    "q_projection": dp._sql_lab("SELECT " + ", ".join(
        f"{sql_round_sig(c, DIG)} AS {c}" if c in DOUBLE_COLS else c for c in dp.LABELLED_COLS) + " FROM lab"),
    "q_label_ids": dp._sql_lab(f"SELECT id, title AS text, {_CASE} AS labels, split FROM sv_msg_all",
                               extra=dp._split_ctes("msg_all")),
    "q_train_val_union": dp._sql_lab("SELECT id, label, split FROM sv_msg_all WHERE split IN ('train', 'val')",
                                     extra=dp._split_ctes("msg_all")),
}
