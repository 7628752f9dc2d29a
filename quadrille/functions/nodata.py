"""Nodata is NULL in the relational form. A computed NaN is nodata too; infinities are values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def no_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def finite(x: Column) -> Column:
    """x where it is a finite number, else NULL."""
    return F.when(F.abs(no_nan(x)) < INF, x)


def known(x: Column, sentinel: float | None) -> Column:
    """Normalises a band at its source: NaN and the band's own sentinel become NULL."""
    x = no_nan(x.cast("double"))
    return x if sentinel is None or sentinel != sentinel else F.when(x != sentinel, x)


def bands(columns: list[str]) -> list[str]:
    """b0, b1, ... among the columns, in order."""
    return sorted((c for c in columns if c[:1] == "b" and c[1:].isdigit()), key=lambda c: int(c[1:]))
