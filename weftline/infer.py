"""Output encodings, and Spark return types, from the annotations of a function."""

from __future__ import annotations

import typing
from collections.abc import Callable
from typing import Any

from pyspark.sql import types as T

from weftline.model import Encoding

_SPARK = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType()}


def _returned(fun: Callable[..., Any]) -> Any:
    try:
        hints = typing.get_type_hints(fun)
    except (NameError, TypeError) as problem:
        raise TypeError(f"annotations of {fun!r} can't be read") from problem
    if "return" not in hints:
        raise TypeError(f"{fun!r} has no return annotation; give out=")
    return hints["return"]


def output_types(fun: Callable[..., Any]) -> tuple[Encoding, ...]:
    """One encoding per output: a tuple annotation has one for each of its parts."""
    made = _returned(fun)
    parts: tuple = (made,)
    if typing.get_origin(made) is tuple:
        parts = typing.get_args(made)
        if Ellipsis in parts:
            raise TypeError("a tuple of any length has no fixed outputs; give out=")
    return tuple(Encoding.blob if p is bytes else Encoding.json for p in parts)


def spark_type(fun: Callable[..., Any]) -> T.DataType:
    """For registering the function as a UDF."""

    def of(hint: Any) -> T.DataType:
        origin, args = typing.get_origin(hint), typing.get_args(hint)
        if hint in _SPARK:
            return _SPARK[hint]
        if origin is list:
            return T.ArrayType(of(args[0]))
        if origin is dict:
            return T.MapType(of(args[0]), of(args[1]))
        if origin is tuple and Ellipsis not in args:
            return T.StructType([T.StructField(f"out{i}", of(a)) for i, a in enumerate(args)])
        raise TypeError(f"no Spark type for {hint!r}")

    return of(_returned(fun))
