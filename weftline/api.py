"""What users call: lazy steps over artefacts, and getting at their values."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any, TypeVar

from weftline import infer, mustache
from weftline.flow import Flow, current, load_data, options
from weftline.model import Artefact, Encoding, Error, Function, How, Operation, Options, ShellOutput, match, unwrap

#: Names of steps enter their hashes, so these have to be what they are.
MAPPING, MORPH, REDUCE, SAC = "mapping_", "morph:", "reduce:", "SAC|"
TEMPLATE, TEMPLATE_STRIPPED = "template (chevrons)", "template (chevrons, stripped)"

S = TypeVar("S")
T = TypeVar("T")
Target = Any
Thing = Artefact | Operation | ShellOutput


log = logging.getLogger("weftline")


def _flow(connection: Flow | None) -> Flow:
    return connection or current()


def as_artefact(flow: Flow, value: Any) -> Artefact:
    return value if isinstance(value, Artefact) else flow.constant(value)


def _hash(thing: Thing | str) -> str:
    return thing if isinstance(thing, str) else thing.hash


def _outputs(flow: Flow, thing: Thing) -> list[str]:
    if isinstance(thing, Artefact):
        return [thing.hash]
    op = thing.op if isinstance(thing, ShellOutput) else thing
    return list(op.out.values())


# ------------------------------------------------------------------ values
def put(value: T, *, connection: Flow | None = None) -> Artefact[T]:
    """Store a value under the hash of its content: bytes as they are, all else as JSON."""
    return _flow(connection).constant(value)


def take(where: Artefact[T], *, strict: bool = True, connection: Flow | None = None) -> T | Error:
    """The value; an error is raised as UnwrapError, or returned if not strict."""
    value = _flow(connection).read(where.hash)
    return unwrap(value) if strict else value


def takeout(where: Artefact, filename: str, *, connection: Flow | None = None) -> None:
    """Copy the bytes of a value, as they are stored, to a file."""
    flow = _flow(connection)
    data = unwrap(load_data(flow.store, flow.resolve(where.hash)))
    with open(filename, "wb") as f:
        f.write(data)


def execute(*targets: Thing, connection: Flow | None = None) -> None:
    """Compute the targets and all they need."""
    _flow(connection).execute(*(_hash(t) for t in targets))


def wait_for(thing: Thing, timeout: float | None = None, *, connection: Flow | None = None) -> None:
    flow = _flow(connection)
    flow.wait(_outputs(flow, thing), timeout)


def reset(thing: Thing, *, recursive: bool = True, connection: Flow | None = None) -> None:
    """Forget the outputs of a step and, if recursive, of all that follow from it."""
    _flow(connection).reset(_hash(thing), recursive)


def get(target: str, *, connection: Flow | None = None) -> list[Artefact | Function | Operation]:
    return _flow(connection).find(target)


# ------------------------------------------------------------------ Python steps
class _Named:
    """Bodies are classes, so that they can be sent to workers with what they hold."""

    def __init__(self, fun: Callable[..., Any], inputs: Sequence[str], outputs: Sequence[str]):
        self.fun, self.inputs, self.outputs = fun, inputs, outputs

    def __call__(self, values: Mapping[str, Any]) -> dict[str, Any]:
        made = self.fun(*(values[k] for k in self.inputs))
        return dict(zip(self.outputs, (made,) if len(self.outputs) == 1 else made))


def _python(flow: Flow, fun: Callable[..., Any], what: str, inp: Sequence[Target], out: Sequence[Encoding], strict: bool, opt: Options | None) -> tuple[Artefact, ...]:
    given = {f"in{i}": as_artefact(flow, x) for i, x in enumerate(inp)}
    outputs = {f"out{i}": e for i, e in enumerate(out)}
    function = Function(How.python, what, {k: a.kind for k, a in given.items()}, outputs, _Named(fun, list(given), list(outputs)), not strict)
    op = flow.make(function, given, opt)
    return tuple(flow.artefact(op.out[k]) for k in outputs)


def py(fun: Callable[..., Any], *inp: Target, out: Sequence[Encoding] | None = None, name: str | None = None, strict: bool = True, opt: Options | None = None, connection: Flow | None = None) -> Any:
    """n inputs to m outputs; a tuple of artefacts, or the only one."""
    made = _python(_flow(connection), fun, name or f"{MAPPING}{len(inp)}:{fun.__qualname__}", inp, out if out is not None else infer.output_types(fun), strict, opt)
    return made[0] if len(made) == 1 else made


def _kind(fun: Callable[..., Any], given: Iterable[Artefact], out: Encoding | None) -> Encoding:
    """Given, else annotated, else that of the inputs if they agree."""
    if out is not None:
        return out
    try:
        (kind,) = infer.output_types(fun)
        return kind
    except (TypeError, ValueError):
        kinds = {a.kind for a in given}
        if len(kinds) != 1:
            raise TypeError("the inputs differ in kind; give out= or annotate the function") from None
        return kinds.pop()


def morph(fun: Callable[[S], T], inp: Artefact[S] | S, *, out: Encoding | None = None, name: str | None = None, strict: bool = True, opt: Options | None = None, connection: Flow | None = None) -> Artefact[T]:
    """One input to one output."""
    flow = _flow(connection)
    given = as_artefact(flow, inp)
    return _python(flow, fun, name or f"{MORPH}{fun.__qualname__}", [given], [_kind(fun, [given], out)], strict, opt)[0]


def reduce(fun: Callable[..., T], *inp: Target, out: Encoding | None = None, name: str | None = None, strict: bool = True, opt: Options | None = None, connection: Flow | None = None) -> Artefact[T]:
    """n inputs to one output."""
    flow = _flow(connection)
    given = [as_artefact(flow, x) for x in inp]
    return _python(flow, fun, name or f"{REDUCE}{fun.__qualname__}", given, [_kind(fun, given, out)], strict, opt)[0]


# ------------------------------------------------------------------ commands and templates
def shell(*args: str, inp: Mapping[Any, Target] | None = None, out: Iterable[Any] | None = None, env: Mapping[str, str] | None = None, strict: bool = True, opt: Options | None = None, connection: Flow | None = None) -> ShellOutput:
    """Commands over files. Return codes are data; a declared file that is missing is an error."""
    from weftline.running import RETURNCODE, STDERR, STDOUT

    flow = _flow(connection)
    if not all(isinstance(a, str) for a in args):
        raise TypeError("commands are strings")
    for k, v in (inp or {}).items() if isinstance(inp, Mapping) else ():
        if isinstance(v, str):
            log.warning("input %s is a str: its file will hold JSON, with quotes; give bytes for plain text", k)
    if inp is not None and not isinstance(inp, Mapping):
        raise TypeError("inp maps file names to values")
    given = {str(k): as_artefact(flow, v) for k, v in (inp or {}).items()}
    outputs = {str(k): Encoding.blob for k in out or ()}
    for i in range(len(args)):
        outputs |= {f"{STDOUT}{i}": Encoding.blob, f"{STDERR}{i}": Encoding.blob, f"{RETURNCODE}{i}": Encoding.json}
    function = Function(How.shell, " && ".join(args), {k: a.kind for k, a in given.items()}, outputs, (list(args), dict(env or {})), not strict)
    return flow.shell_output(flow.make(function, given, opt))


class _Rendered:
    def __init__(self, template_key: str, env_key: str, strip: bool):
        self.template_key, self.env_key, self.strip = template_key, env_key, strip

    def __call__(self, values: Mapping[str, Any]) -> dict[str, bytes]:
        texts = {k: v.decode() if isinstance(v, bytes) else v for k, v in values.items()}
        source, env = texts.pop(self.template_key), texts.pop(self.env_key) or {}
        if self.strip:
            texts = {k: v.strip() if isinstance(v, str) else v for k, v in texts.items()}
        texts |= {k: os.environ.get(v) for k, v in env.items()}
        return {"out": mustache.render(source, texts).encode()}


def template(template: Target, data: Mapping[str, Target], strip: bool = True, *, env: Mapping[str, str] | None = None, name: str | None = None, opt: Options | None = None, connection: Flow | None = None) -> Artefact[bytes]:
    """A mustache template filled from artefacts; ``env`` names variables of the worker's environment."""
    flow = _flow(connection)

    def text(x: Target) -> Artefact:
        return as_artefact(flow, x.decode() if isinstance(x, bytes) else x)

    given = {k: text(v) for k, v in data.items()}

    def free(key: str) -> str:
        while key in given:
            key += "_"
        return key

    template_key = free("template")
    given[template_key] = text(template)
    env_key = free("env")
    given[env_key] = as_artefact(flow, dict(env) if env is not None else None)
    what = name or (TEMPLATE_STRIPPED if strip else TEMPLATE)
    function = Function(How.python, what, {k: a.kind for k, a in given.items()}, {"out": Encoding.blob}, _Rendered(template_key, env_key, strip))
    return flow.artefact(flow.make(function, given, opt).out["out"])


# ------------------------------------------------------------------ dynamic steps
class _Unfolded:
    def __init__(self, split: Callable, apply: Callable, combine: Callable, inputs: Sequence[str]):
        self.split, self.apply, self.combine, self.inputs = split, apply, combine, inputs

    def __call__(self, values: Mapping[str, Any]) -> dict[str, Artefact]:
        parts = self.split(*(values[k] for k in self.inputs))
        return {"out": self.combine([self.apply(put(p)) for p in parts])}


def sac(split_fun: Callable[..., Sequence], apply_fun: Callable[[Artefact], Artefact], combine_fun: Callable[[Sequence[Artefact]], Artefact], *inp: Target, out: Encoding, name: str | None = None, strict: bool = True, opt: Options | None = None, connection: Flow | None = None) -> Artefact:
    """Split a value, apply steps to each part, combine: how many parts there are shows when it runs."""
    flow = _flow(connection)
    given = {f"in{i}": as_artefact(flow, x) for i, x in enumerate(inp)}
    what = name or f"{SAC}{split_fun.__qualname__}|{apply_fun.__qualname__}|{combine_fun.__qualname__}"
    function = Function(How.subdag, what, {k: a.kind for k, a in given.items()}, {"out": out}, _Unfolded(split_fun, apply_fun, combine_fun, list(given)), not strict)
    return flow.artefact(flow.make(function, given, opt).out["out"])


def subdag(fun: Callable[[Mapping[str, Any]], Mapping[str, Artefact]], inp: Mapping[str, Target], out: Mapping[str, Encoding], *, name: str | None = None, strict: bool = True, opt: Options | None = None, connection: Flow | None = None) -> dict[str, Artefact]:
    """A step whose function declares further steps and returns their artefacts."""
    flow = _flow(connection)
    given = {k: as_artefact(flow, x) for k, x in inp.items()}
    function = Function(How.subdag, name or fun.__qualname__, {k: a.kind for k, a in given.items()}, dict(out), fun, not strict)
    op = flow.make(function, given, opt)
    return {k: flow.artefact(h) for k, h in op.out.items()}


__all__ = ["put", "take", "takeout", "execute", "wait_for", "reset", "get", "py", "morph", "reduce", "shell", "template", "sac", "subdag", "options", "unwrap", "match", "Error"]
