"""Running one operation: what a worker does."""

from __future__ import annotations

import signal
import subprocess
import threading
import traceback
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from weftline import codec
from weftline.model import Encoding, Error, ErrorKind, Function, How
from weftline.operators import shell

#: Names of the outputs of shell steps besides their files: fixed values.
STDOUT, STDERR, RETURNCODE = "__special__/stdout", "__special__/stderr", "__special__/returncode"


class _TimedOut(Exception):
    pass


class _Signalled(Exception):
    pass


@contextmanager
def _watched(timeout: float) -> Iterator[None]:
    """Turns a timeout, SIGINT and SIGTERM into exceptions; only the main thread can."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(number, _):
        raise _TimedOut() if number == signal.SIGALRM else _Signalled(signal.Signals(number).name)

    numbers = [signal.SIGINT, signal.SIGTERM] + [signal.SIGALRM] * (timeout > 0)
    before = {n: signal.signal(n, stop) for n in numbers}
    if timeout > 0:
        signal.setitimer(signal.ITIMER_REAL, timeout)
    try:
        yield
    finally:
        if timeout > 0:
            signal.setitimer(signal.ITIMER_REAL, 0)
        for n, handler in before.items():
            signal.signal(n, handler)


def failed_input(function: Function, values: Mapping[str, Any]) -> Error | None:
    """For a strict function, the error of its first failed input in stored order."""
    if function.error_tolerant:
        return None
    return next((v for v in values.values() if isinstance(v, Error)), None)


def _shell(function: Function, values: Mapping[str, Any], timeout: float) -> dict[str, Any]:
    commands, env = function.body
    files = {k: None if isinstance(v, Error) else codec.encode(function.inp[k], v) for k, v in values.items()}
    wanted = [k for k in function.out if not k.startswith("__special__/")]
    ran = shell.run(commands, files, wanted, env, timeout if timeout > 0 else None)
    out: dict[str, Any] = dict(ran.files)
    for i in range(len(commands)):
        out |= {f"{STDOUT}{i}": ran.stdouts[i], f"{STDERR}{i}": ran.stderrs[i], f"{RETURNCODE}{i}": ran.returncodes[i]}
    return out


def run(operation: str, function: Function, values: Mapping[str, Any], timeout: float = -1) -> dict[str, bytes | Error]:
    """Encoded outputs by name. Whatever goes wrong becomes an error of every output it hits."""
    if bad := failed_input(function, values):
        return dict.fromkeys(function.out, bad)
    try:
        with _watched(timeout):
            out = _shell(function, values, timeout) if function.how is How.shell else function.body(values)
    except (_TimedOut, subprocess.TimeoutExpired):
        return dict.fromkeys(function.out, Error(ErrorKind.JobTimedOut, operation, f"more than {timeout} s"))
    except _Signalled as got:
        return dict.fromkeys(function.out, Error(ErrorKind.KilledBySignal, operation, str(got)))
    except Exception:
        return dict.fromkeys(function.out, Error(ErrorKind.ExceptionRaised, operation, traceback.format_exc()))
    made: dict[str, bytes | Error] = {}
    for name, encoding in function.out.items():
        value = out.get(name)
        if value is None:
            made[name] = Error(ErrorKind.MissingOutput, operation, f"{name} was not made")
        else:
            data = codec.encode(encoding, value)
            made[name] = Error(data.kind, operation, data.details) if isinstance(data, Error) and data.source is None else data
    return made


def decode_input(encoding: Encoding, data: bytes | Error, source: str) -> Any:
    return codec.decode(encoding, data, source)
