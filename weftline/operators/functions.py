"""Python functions as steps over results, for what expressions can't say."""

from __future__ import annotations

import traceback
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline import infer
from weftline.operators import results


def result_udf(fun: Callable[..., Any], returns: T.DataType | str | None = None, source: str | None = None, strict: bool = True) -> Callable[..., Column]:
    """A function over result columns; rows travel in Arrow batches.

    Strict: the first failed input's error is passed on and ``fun`` gets values. Lax: it gets (value,
    error) pairs. An exception becomes an ExceptionRaised error, None a MissingOutput; the return type
    is that of the annotations unless given.
    """
    kind = infer.spark_type(fun) if returns is None else returns
    kind = T.DataType.fromDDL(kind) if isinstance(kind, str) else kind
    failure = T.DataType.fromDDL(results.ERROR_TYPE)
    schema = T.StructType([T.StructField("value", kind), T.StructField("error", failure)])
    name = source or fun.__qualname__

    def each(*given: Any) -> tuple:
        inputs = [tuple(r) for r in given]  # (value, error)
        if strict:
            for _, error in inputs:
                if error is not None:
                    return None, tuple(error)
        try:
            value = fun(*(value if strict else (value, error) for value, error in inputs))
        except Exception:
            return None, ("ExceptionRaised", name, traceback.format_exc())
        return (None, ("MissingOutput", name, None)) if value is None else (value, None)

    return F.udf(each, schema, useArrow=True)


def outputs(result: Column, names: list[str]) -> list[Column]:
    """One result column per output of a function that returns a tuple (fields out0, out1, ...)."""
    return [F.struct(result["value"][f"out{i}"].alias("value"), result["error"].alias("error")).alias(n) for i, n in enumerate(names)]
