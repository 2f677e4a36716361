"""Split, apply, combine where the number of parts is known at run time only."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_row(parts: Column, apply: Callable[[Column], Column], combine: Callable[[Column], Column]) -> Column:
    """Parts as an array of one row: no shuffle. ``apply`` may itself be an in_row()."""
    return combine(F.transform(parts, apply))


def in_row_results(parts: Column, apply: Callable[[Column], Column], combine: Callable[[Column], Column]) -> Column:
    """Like in_row() for an ``apply`` that gives results; the first error is that of the whole."""
    done = F.transform(parts, apply)
    failed = F.element_at(F.concat(F.transform(F.filter(done, lambda r: r["error"].isNotNull()), lambda r: r["error"]), F.array(F.lit(None).cast("struct<kind:string,source:string,details:string>"))), 1)
    value = combine(F.transform(done, lambda r: r["value"]))
    return F.struct(F.when(failed.isNull(), value).alias("value"), failed.alias("error"))


def exploded(df: DataFrame, keys: list[str], parts: Column, apply: Callable[[DataFrame], DataFrame], combine: Callable[[Column], Column], out: str = "value") -> DataFrame:
    """Parts as rows (keys, pos, part): for steps too heavy for one task per row.

    ``apply`` is any DataFrame step that keeps keys and pos and adds ``value``; ``combine`` gets the
    values of a key in order. Rows without parts combine an empty array.
    """
    rows = df.select(*keys, F.posexplode_outer(parts).alias("pos", "part"))
    done = apply(rows)
    listed = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "value"))))
    return done.groupBy(*keys).agg(combine(F.transform(listed, lambda p: p["value"])).alias(out))


def ordered(value: Column, order: Column) -> Column:
    """Aggregate: the values of a group as an array by rising ``order``."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda p: p["v"])


def split_by(fun: Callable[[Any], Iterable[Any]], part: str) -> Callable[..., Column]:
    """A Python function from a value to its parts, of SQL type ``part``, as a column of parts; null has none.

    Rows travel in Arrow batches. For exploded(), and for in_row() where the steps are columns.
    """
    return F.udf(lambda value: [] if value is None else list(fun(value)), f"array<{part}>", useArrow=True)


def combine_by(fun: Callable[[Sequence[Any]], Any], out: str) -> Callable[[Column], Column]:
    """A Python function from the ordered values of a key to one value of SQL type ``out``, as a combine step."""
    return F.udf(lambda values: fun([] if values is None else list(values)), out, useArrow=True)
