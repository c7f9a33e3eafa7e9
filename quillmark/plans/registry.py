"""Query registry: merges the per-domain query modules."""

from __future__ import annotations

import importlib

MODULES = ["history", "dataset", "profile", "evaluation", "text", "models", "boosting", "svm", "scoring", "clusters", "io", "arrivals", "lang", "shape"]


def _mods():
    return [importlib.import_module(f"quillmark.plans.{m}") for m in MODULES]


def queries():
    out = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _mods():
        out.update(m.ORACLE)
    return out


def flagship(spark, sf_dir):
    from quillmark.plans.dataset import q_label_counts_by_symbol
    return q_label_counts_by_symbol(spark, sf_dir)
