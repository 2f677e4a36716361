"""Writes what is known of an artefact or operation to a folder."""

from __future__ import annotations

import json
import os
from dataclasses import asdict
from typing import Any

from weftline import codec
from weftline.flow import Flow, current
from weftline.model import Artefact, Error, Function, How, Operation, ShellOutput


def _write(place: str, data: bytes | str) -> None:
    os.makedirs(os.path.dirname(place), exist_ok=True)
    with open(place, "wb") as f:
        f.write(data.encode() if isinstance(data, str) else data)


def _json(place: str, value: Any) -> None:
    _write(place, json.dumps(value, indent=2, sort_keys=True, default=str))


def artefact(flow: Flow, target: Artefact, folder: str) -> None:
    """metadata.json, and data or error.json."""
    _json(f"{folder}/metadata.json", {"hash": target.hash, "parent": target.parent, "kind": target.kind.value, "status": flow.status(target.hash).name})
    value = flow.read(target.hash)
    if isinstance(value, Error):
        _json(f"{folder}/error.json", asdict(value))
    else:
        _write(f"{folder}/data", codec.encode(target.kind, value))


def operation(flow: Flow, op: Operation, folder: str) -> None:
    function = flow.function_of(op)
    if function.how is How.subdag:
        raise RuntimeError("a step that unfolds has no values of its own")
    errors: dict[str, Any] = {}

    def values(names, kinds, sub: str) -> None:
        for k, h in names.items():
            value = flow.read(h)
            if isinstance(value, Error):
                errors[k] = asdict(value)
                continue
            data = codec.encode(kinds[k], value)
            special = k.removeprefix("__special__/")
            _write(f"{folder}/{special}" if special != k else f"{folder}/{sub}/{k}", data)

    if function.how is How.shell:
        values(op.inp, function.inp, "input_files")
        values(op.out, function.out, "output_files")
        commands, env = function.body
        _write(f"{folder}/op.sh", "\n".join(commands) + "\n")
        _write(f"{folder}/op.env", "".join(f"{k}={v}\n" for k, v in sorted(env.items())))
    else:
        values(op.inp, function.inp, "inputs")
        values(op.out, function.out, "outputs")
        _json(f"{folder}/function.json", {"hash": function.hash, "how": function.how.name, "what": function.what, "inp": function.inp, "out": function.out, "error_tolerant": function.error_tolerant})
    _json(f"{folder}/errors.json", errors)
    _json(f"{folder}/operation.json", {"hash": op.hash, "function": op.function, "what": function.what, "inp": dict(op.inp), "out": dict(op.out), "options": op.options.pack()})


def dump(target: Any, folder: str, *, connection: Flow | None = None) -> None:
    flow = connection or current()
    if isinstance(target, ShellOutput):
        target = target.op
    if isinstance(target, Artefact):
        artefact(flow, target, folder)
    elif isinstance(target, Operation):
        operation(flow, target, folder)
    elif isinstance(target, Function):
        raise NotImplementedError("a function has no values")
    else:
        raise RuntimeError(f"nothing to dump for {target!r}")
