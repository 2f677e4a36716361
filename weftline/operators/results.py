"""Values that may be errors, as columns.

A result is struct<value, error> with exactly one side set; an error is
struct<kind, source, details>, and its source stays the step where it arose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_TYPE = "struct<kind:string,source:string,details:string>"


def error(kind: str, source: Column | str, details: Column | str | None = None) -> Column:
    source = F.lit(source) if isinstance(source, str) else source
    details = F.lit(details) if isinstance(details, (str, type(None))) else details
    return F.struct(F.lit(kind).alias("kind"), source.cast("string").alias("source"), details.cast("string").alias("details"))


def no_error() -> Column:
    return F.lit(None).cast(ERROR_TYPE)


def ok(value: Column) -> Column:
    return F.struct(value.alias("value"), no_error().alias("error"))


def guard(value: Column, failed: Column, kind: str, source: str, details: str | None = None) -> Column:
    """The value, or an error where ``failed`` holds."""
    return F.struct(F.when(~failed | failed.isNull(), value).alias("value"), F.when(failed, error(kind, source, details)).alias("error"))


def is_error(result: Column) -> Column:
    return result["error"].isNotNull()


def first_error(*results: Column) -> Column:
    """The error of the first failed input, in the given order."""
    return F.coalesce(*(r["error"] for r in results)) if results else no_error()


def strict(fun: Callable[..., Column], *inputs: Column) -> Column:
    """Apply to values; any failed input passes its error on unchanged."""
    failed = first_error(*inputs)
    return F.struct(F.when(failed.isNull(), fun(*(i["value"] for i in inputs))).alias("value"), failed.alias("error"))


def chain(fun: Callable[..., Column], *inputs: Column) -> Column:
    """Like strict() for a function that itself gives a result."""
    failed = first_error(*inputs)
    made = fun(*(i["value"] for i in inputs))
    return F.struct(F.when(failed.isNull(), made["value"]).alias("value"), F.coalesce(failed, made["error"]).alias("error"))


def lax(fun: Callable[..., Column], *inputs: Column) -> Column:
    """Apply to whole results: the function sees errors and decides."""
    return ok(fun(*inputs))


def match(result: Column, some: Callable[[Column], Column], none: Callable[[Column], Column]) -> Column:
    return F.when(result["error"].isNull(), some(result["value"])).otherwise(none(result["error"]))


def match_results(results: Column, some: Callable[[Column], Column], none: Callable[[Column], Column] | None = None) -> Column:
    """Over an array of results; without ``none``, errors are dropped."""
    if none is None:
        return F.transform(F.filter(results, lambda r: r["error"].isNull()), lambda r: some(r["value"]))
    return F.transform(results, lambda r: match(r, some, none))


def unwrap(result: Column) -> Column:
    """The value; a failed one ends the query."""
    return F.when(result["error"].isNotNull(), F.raise_error(F.concat_ws(": ", result["error"]["kind"], result["error"]["details"]))).otherwise(result["value"])


def stop_if(result: Column, predicate: Callable[[Column], Column], source: str = "stop_if") -> Column:
    return chain(lambda v: guard(v, predicate(v), "ExceptionRaised", source), result)


def not_empty(result: Column, source: str = "not_empty") -> Column:
    return stop_if(result, lambda v: F.octet_length(v) == 0, source)


def barrier(kept: Column, condition: Column) -> Column:
    """``kept`` if ``condition`` has no error, else its own or that error."""
    return strict(lambda a, _: a, kept, condition)


def missing_output(value: Column, source: str) -> Column:
    """A step that gives null has given nothing."""
    return guard(value, value.isNull(), "MissingOutput", source)


def from_status(status: Column, data: Column, stored: Column, source: Column) -> Column:
    """What reading an artefact gives: data, its stored error, or why there is none."""
    failed = (
        F.when(status == 4, error("UnresolvedLink", source))
        .when(status == 3, stored)
        .when(F.coalesce(status, F.lit(-1)) <= 0, error("NotFound", source))
    )
    return F.struct(F.when(failed.isNull(), data).alias("value"), failed.alias("error"))
