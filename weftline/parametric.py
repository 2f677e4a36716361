"""Parts of a workflow by name: commit what lies between some inputs and outputs, recall it with others."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from weftline import api, identity
from weftline.flow import Flow, current
from weftline.model import Artefact


def _between(flow: Flow, inp: Mapping[str, Artefact], out: Mapping[str, Artefact]) -> set[str]:
    """Operations that the outputs need and that see an input; all others keep their values."""
    ends = {op for a in out.values() if (op := flow.nearest(a.hash))}
    needed = ends | flow.ancestors(*ends)
    given = {a.hash for a in inp.values()}
    seeing = {n for n in needed if given & set(flow.operation(n).inp.values())}
    return needed & (seeing | flow.descendants(*seeing)) | ends


def _hash(flow: Flow, ops: list[str], inp: Mapping[str, Artefact], out: Mapping[str, Artefact]) -> str:
    """Inputs count by name, so equal workflows over other values are equal."""
    names = {a.hash: k for k, a in inp.items()}
    for n in ops:
        op = flow.operation(n)
        made = identity.parametric_operation(op.function, {k: names.setdefault(h, h) for k, h in op.inp.items()})
        names.update({h: f"{made}:{k}" for k, h in op.out.items()})
    return identity.parametric({k: names.get(a.hash, a.hash) for k, a in out.items()})


def commit(name: str, inp: Mapping[str, Artefact], out: Mapping[str, Artefact], *, connection: Flow | None = None) -> str:
    """Its hash. The last commit of a name wins."""
    flow = connection or current()
    ops = [n for wave in flow.waves(_between(flow, inp, out)) for n in wave]
    hash = _hash(flow, ops, inp, out)
    record = {"name": name, "ops": ops, "inp": {k: a.hash for k, a in inp.items()}, "out": {k: a.hash for k, a in out.items()}}
    flow.store.put("parametrics", hash, json.dumps(record).encode())
    flow.store.put("parametric_names", identity.digest(name), hash.encode())
    return hash


def recall(name_or_hash: str, inp: Mapping[str, Any], *, connection: Flow | None = None) -> dict[str, Artefact]:
    """The outputs for new inputs; those not given keep their committed values. Nothing runs yet."""
    flow = connection or current()
    named = flow.store.get("parametric_names", identity.digest(name_or_hash))
    raw = flow.store.get("parametrics", named.decode() if named else name_or_hash)
    if raw is None:
        raise RuntimeError(f"nothing was committed as {name_or_hash}")
    record = json.loads(raw)
    if unknown := set(inp) - set(record["inp"]):
        raise AttributeError(f"no input {', '.join(sorted(unknown))}")
    now: dict[str, Artefact] = {}
    for k, value in inp.items():
        old = flow.artefact(record["inp"][k])
        now[old.hash] = given = api.as_artefact(flow, value)
        if given.kind is not old.kind:
            raise TypeError(f"input {k} is {given.kind.value}, not {old.kind.value}")
    for n in record["ops"]:
        op = flow.operation(n)
        made = flow.make(flow.function_of(op), {k: now.get(h) or flow.artefact(h) for k, h in op.inp.items()}, op.options)
        now.update({h: flow.artefact(made.out[k]) for k, h in op.out.items()})
    return {k: now.get(h) or flow.artefact(h) for k, h in record["out"].items()}
