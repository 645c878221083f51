"""Bind a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, computing ``value`` once however often ``use`` refers to it.

    Keeps expression trees small, and keeps lambdas from repeating their inputs per element.
    """
    return F.transform(F.array(value), use).getItem(0)
