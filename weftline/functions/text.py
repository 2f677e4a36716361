"""Text functions of workflows as column expressions."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline import mustache
from weftline.operators import results

#: The white space that stripping bytes removes.
WHITE = " \t\n\r\x0b\x0c"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE))


def concat(*parts: Column, join: str = "", strip_each: bool = False) -> Column:
    """Parts in order with ``join`` between them; null parts are left out."""
    return F.concat_ws(join, *(strip(p) if strip_each else p for p in parts))


def concat_results(*parts: Column, join: str = "", strip_each: bool = False, strict: bool = True) -> Column:
    """concat() over results: strict passes the first error on, lax leaves failed parts out."""
    if strict:
        return results.strict(lambda *vs: concat(*vs, join=join, strip_each=strip_each), *parts)
    return results.ok(concat(*(p["value"] for p in parts), join=join, strip_each=strip_each))


def concat_rows(value: Column, order: Column, join: str = "", strip_each: bool = False) -> Column:
    """Aggregate: the values of a group joined by rising ``order``; null values are left out."""
    value = strip(value) if strip_each else value
    pairs = F.filter(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda p: p["v"].isNotNull())
    return F.array_join(F.transform(pairs, lambda p: p["v"]), join)


def truncate(text: Column, top: int = 0, bottom: int = 0, separator: str = "\n") -> Column:
    """parts[top : len - bottom] with the meaning of a Python slice, also where the end is negative."""
    parts = F.split(text, re.escape(separator) if separator != "\n" else "\n", -1)
    n = F.size(parts)
    stop = n - bottom
    stop = F.when(stop < 0, F.greatest(stop + n, F.lit(0))).otherwise(stop)
    return F.array_join(F.slice(parts, F.lit(top + 1), F.greatest(stop - top, F.lit(0))), separator)


def chunks(data: Column, size: int) -> Column:
    """The value cut in blocks of ``size`` bytes; an empty value has one empty block. ``data`` is evaluated once."""

    def cut(whole):
        n = F.greatest(F.ceil(F.octet_length(whole) / size), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(whole, i * size + 1, F.lit(size)))

    return F.transform(F.array(data), cut)[0]


def template(text: str, values: Mapping[str, Column]) -> Column:
    """``{{name}}`` replaced by values stripped of white space, ``{{{name}}}`` and ``{{&name}}`` alike.

    Only plain variables are expressed here, escaped for HTML unless tripled; rendered() has sections.
    """
    out: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{\{\s*([\w.]+)\s*\}\}\}|\{\{(&?)\s*([\w.]+)\s*\}\}", text):
        out.append(F.lit(text[at : m.start()]))
        name, plain = (m[1], True) if m[1] else (m[3], bool(m[2]))
        value = F.coalesce(strip(values[name].cast("string")), F.lit("")) if name in values else F.lit("")
        out.append(value if plain else escape_html(value))
        at = m.end()
    return F.concat(*out, F.lit(text[at:]))


def rendered(text: str, values: Mapping[str, Column], env: Mapping[str, str] | None = None) -> Column:
    """A whole mustache template over columns: sections, inverted sections, comments, delimiters.

    Strings are stripped of white space; arrays make a section repeat, structs and maps open a scope.
    ``env`` maps names to variables of the worker's environment. Rows travel in Arrow batches.
    """
    names = list(values)

    def plain(value):
        if hasattr(value, "asDict"):
            return {k: plain(v) for k, v in value.asDict().items()}
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items()}
        if isinstance(value, (list, tuple)):
            return [plain(v) for v in value]
        return value.strip() if isinstance(value, str) else value

    def fill(*row):
        return mustache.render(text, {**{n: plain(v) for n, v in zip(names, row)}, **{n: os.environ.get(v) for n, v in (env or {}).items()}})

    return F.udf(fill, "string", useArrow=True)(*values.values())


def escape_html(value: Column) -> Column:
    for char, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def dot_label(text: Column) -> Column:
    """A command or function name as a DOT record label."""
    text = F.regexp_replace(text, r"\.<locals>.*$", "")
    text = F.regexp_replace(text, " *&& *", "\n")
    return F.regexp_replace(text, r'([<>|{}"])', r"\\$1")
