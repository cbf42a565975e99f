"""Window building blocks."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec


def per(*keys: str, order: str | list[str]) -> WindowSpec:
    names = [order] if isinstance(order, str) else order
    return Window.partitionBy(*keys).orderBy(*names)


def last_rows(spec: WindowSpec, count: int) -> WindowSpec:
    """Frame of the current row and the ``count - 1`` rows before it."""
    return spec.rowsBetween(1 - count, 0)


def before(spec: WindowSpec, count: int) -> WindowSpec:
    """Frame of the ``count`` rows before the current one."""
    return spec.rowsBetween(-count, -1)


def up_to_now(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, 0)
