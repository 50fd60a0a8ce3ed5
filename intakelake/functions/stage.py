"""Evaluate costly columns once.

Catalyst pushes a filter through projections by inlining the projected expressions, so a
pattern chain that feeds several filters would run several times per row. A one-element
``inline`` is a boundary that filters on its output do not cross; it stays inside
whole-stage code generation and moves no data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **cols: Column) -> DataFrame:
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
