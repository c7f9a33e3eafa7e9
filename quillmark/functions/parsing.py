"""Parsers for raw text cells (A4, A5, F6, F9, F10) as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.numeric import col_

CATEGORY_SCHEMA = "array<struct<id:int,category_en:string,category_no:string>>"


def price_cell(c) -> Column:
    """A4: 'kr 1,234.5' -> 1234.5; a cell without 'kr' -> NULL (drop 3 leading chars and commas)."""
    c = col_(c)
    num = F.regexp_replace(F.substring(c, 4, 1 << 30), ",", "")
    return F.when(c.contains("kr"), num.try_cast("double"))


def volume_cell(c) -> Column:
    """A5: '12,345' -> 12345.0 (NULL when unparsable)."""
    return F.regexp_replace(col_(c).cast("string"), ",", "").try_cast("double")


def category_id(c) -> Column:
    """id of the first entry of a Python-literal list of dicts, parsed as JSON (never evaluated)."""
    parsed = F.from_json(col_(c), CATEGORY_SCHEMA, {"allowSingleQuotes": "true"})
    return F.try_element_at(parsed, F.lit(1)).getField("id")


def category_name(c) -> Column:
    parsed = F.from_json(col_(c), CATEGORY_SCHEMA, {"allowSingleQuotes": "true"})
    return F.try_element_at(parsed, F.lit(1)).getField("category_en")


def checkpoint_step(name) -> Column:
    """G2 helper: numeric suffix after the last '-' (NULL when not a number)."""
    return F.element_at(F.split(col_(name), "-"), -1).try_cast("int")


# Model families of the scoring sweep.
FINBERT, XLMR = "ProsusAI/finbert", "xlm-roberta-base"


def base_model(variant) -> Column:
    """base model of a variant name: finbert when the name says so, else xlm-roberta-base."""
    return F.when(F.lower(col_(variant)).contains("finbert"), F.lit(FINBERT)).otherwise(F.lit(XLMR))
