"""Mustache templates: variables, sections, inverted sections, comments, delimiters."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from typing import Any


def _lookup(name: str, scopes: Sequence[Any]) -> Any:
    if name == ".":
        return scopes[-1]
    head, *rest = name.split(".")
    for scope in reversed(scopes):
        if isinstance(scope, dict) and head in scope:
            value = scope[head]
            for part in rest:
                value = value.get(part) if isinstance(value, dict) else None
            return value
    return None


def _text(value: Any) -> str:
    return "" if value is None or value is False else str(value)


def _escape(text: str) -> str:
    return html.escape(text, quote=False).replace('"', "&quot;")


def _tokens(template: str):
    opened, closed = "{{", "}}"
    at = 0
    while True:
        start = template.find(opened, at)
        if start < 0:
            yield "text", template[at:], ""
            return
        triple = opened == "{{" and template.startswith("{{{", start)
        end_mark = "}}}" if triple else closed
        end = template.find(end_mark, start)
        if end < 0:
            raise ValueError("a tag is not closed")
        inner = template[start + len(opened) + triple : end].strip()
        mark = "{" if triple else (inner[:1] if inner[:1] in "#^/!>&=" else "")
        name = inner.strip("=").strip() if mark == "=" else inner[len(mark) :].strip() if mark != "{" else inner
        before, after = template[at:start], end + len(end_mark)
        if mark and mark in "#^/!=":  # a tag alone on its line takes the line with it
            line = re.search(r"(?:^|\n)([ \t]*)$", before) if at else re.search(r"(?:^|\n)([ \t]*)$", before)
            tail = re.match(r"[ \t]*(?:\r?\n|$)", template[after:])
            fresh = line is not None and (at == 0 or "\n" in before or template[at - 1 : at] == "\n")
            if fresh and tail:
                before = before[: len(before) - len(line[1])]
                after += tail.end()
        yield "text", before, ""
        if mark == "=":
            opened, closed = name.split()
        elif mark != "!":
            yield mark, name, ""
        at = after


def _parse(tokens, inside: str | None = None) -> list:
    out = []
    for mark, name, _ in tokens:
        if mark == "/":
            if name != inside:
                raise ValueError(f"section {name} is closed but not open")
            return out
        out.append((mark, name, _parse(tokens, name)) if mark in ("#", "^") else (mark, name, None))
    if inside is not None:
        raise ValueError(f"section {inside} is not closed")
    return out


def _write(tree: list, scopes: list) -> str:
    out = []
    for mark, name, inner in tree:
        if mark == "text":
            out.append(name)
            continue
        if mark == ">":
            continue
        value = _lookup(name, scopes)
        if mark == "":
            out.append(_escape(_text(value)))
        elif mark in "{&":
            out.append(_text(value))
        elif mark == "^":
            if value is False or not value and value != 0:
                out.append(_write(inner, scopes))
        elif isinstance(value, (list, tuple)):
            out.extend(_write(inner, [*scopes, item]) for item in value)
        elif value or value == 0 and value is not False:
            out.append(_write(inner, [*scopes, value]))
    return "".join(out)


def render(template: str, data: dict[str, Any]) -> str:
    return _write(_parse(_tokens(template)), [data])
