"""Naming a sub-expression, so that a row evaluates it once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: lambda bodies get no common-subexpression pass."""
    return F.element_at(F.transform(F.array(value), body), 1)
