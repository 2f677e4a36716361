"""Steps that many workflows need."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from weftline import api
from weftline.flow import Flow
from weftline.model import Artefact, Encoding, Error, Options, match


#: Names of steps enter their hashes.
CONCATENATE, TRUNCATE, STOP_IF = "concatenate ", "truncate ", "stop_if:"


class _All:
    def __call__(self, *_: Any) -> bytes:
        return b""


def execute_all(things: Iterable[Any], block: bool = False, timeout: float | None = None, *, opt: Options | None = None, connection: Flow | None = None) -> Artefact[bytes]:
    """Compute all; the artefact is empty, or the error of the first that failed."""
    flow = connection or api.current()
    hashes = [h for t in things for h in api._outputs(flow, t)]
    parts = [flow.artefact(h) for h in hashes]
    made = api.reduce(_All(), *parts, out=Encoding.blob, name="execute_all", opt=opt, connection=flow)
    flow.execute(made.hash)
    if block:
        flow.wait([made.hash], timeout)
    return made


def match_results(results: Sequence[Any], some: Callable[[Any], Any], error: Callable[[Error], Any] | None = None) -> list[Any]:
    """some() of values and error() of errors; without error(), errors are left out."""
    if error is None:
        return [some(r) for r in results if not isinstance(r, Error)]
    return [match(r, some, error) for r in results]


def _concat(join: bytes, strip: bool, *parts: Any) -> bytes:
    given = [p for p in parts if not isinstance(p, Error)]
    return join.join(p.strip() if strip else p for p in given)


def concat(*inp: Any, join: bytes = b"", strip: bool = False, strict: bool = True, opt: Options | None = None, connection: Flow | None = None) -> Artefact[bytes]:
    """Join blobs; lax leaves failed ones out."""
    return api.reduce(_concat, join, strip, *inp, out=Encoding.blob, name=f"{CONCATENATE}{len(inp)}", strict=strict, opt=opt, connection=connection)


class _Truncated:
    def __init__(self, top: int, bottom: int, separator: bytes):
        self.top, self.bottom, self.separator = top, bottom, separator

    def __call__(self, data: bytes) -> bytes:
        parts = data.split(self.separator)
        return self.separator.join(parts[self.top : len(parts) - self.bottom])


def truncate(inp: Any, top: int = 0, bottom: int = 0, separator: str | bytes = b"\n", *, opt: Options | None = None, connection: Flow | None = None) -> Artefact[bytes]:
    """Without the first ``top`` and last ``bottom`` parts between separators."""
    mark = separator.encode() if isinstance(separator, str) else separator
    return api.morph(_Truncated(top, bottom, mark), inp, out=Encoding.blob, name=f"{TRUNCATE}{top}:{bottom}:{mark!r}", opt=opt, connection=connection)


class _Stopped:
    def __init__(self, fun: Callable[[Any], bool]):
        self.fun = fun

    def __call__(self, value: Any) -> Any:
        if self.fun(value):
            raise RuntimeError("the value was stopped")
        return value


def stop_if(fun: Callable[[Any], bool], inp: Any, *, opt: Options | None = None, connection: Flow | None = None) -> Artefact:
    """The value, or an error where fun(value) holds."""
    flow = connection or api.current()
    given = api.as_artefact(flow, inp)
    return api.morph(_Stopped(fun), given, out=given.kind, name=f"{STOP_IF}{fun.__qualname__}", opt=opt, connection=flow)


def _empty(value: bytes) -> bool:
    return len(value) == 0


def not_empty(inp: Any, *, opt: Options | None = None, connection: Flow | None = None) -> Artefact[bytes]:
    return stop_if(_empty, inp, opt=opt, connection=connection)
