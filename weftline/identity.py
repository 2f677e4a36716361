"""Causal identity: sha1 of what a value is (constants) or of how it comes about (everything else).

Each formula exists twice: over Python values, and over Columns for whole tables at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags and layouts that enter the digests.
ARTEFACT, CONSTANT, VARIABLE = "artefact\n", "constant\n", "variable\n"
KIND = "kind:Encoding.%s\n"
PARENT, NAME = "parent:%s\n", "name:%s\n"
FUNCTION = "funsie"
HOW, WHAT = "how=%d\n", "what=%s\n"
INPUT, OUTPUT = "input:%s -> %s\n", "output:%s -> %s\n"
TOLERANT = "error tolerant:%d\n"
OPERATION = "op"
OPERAND = "file=%s, hash=%s"
HANDLE = "Artefact(hash='%s', parent='%s', kind=<Encoding.%s: '%s'>)"
PARAMETRIC, PARAMETRIC_OUTPUT = "parametric", "output:%s, hash:%s"
ROOT = "root"
SHORT = 6


def digest(*parts: str | bytes) -> str:
    h = hashlib.sha1()
    for part in parts:
        h.update(part if isinstance(part, bytes) else part.encode())
    return h.hexdigest()


def constant(kind: str, data: bytes) -> str:
    return digest(ARTEFACT, CONSTANT, KIND % kind, data)


def variable(kind: str, operation: str, name: str) -> str:
    return digest(ARTEFACT, VARIABLE, KIND % kind, PARENT % operation, NAME % name)


def function(how: int, what: str, inputs: Mapping[str, str], outputs: Mapping[str, str], tolerant: bool) -> str:
    return digest(
        FUNCTION,
        HOW % how,
        WHAT % what,
        *(INPUT % (k, inputs[k]) for k in sorted(inputs)),
        *(OUTPUT % (k, outputs[k]) for k in sorted(outputs)),
        TOLERANT % int(tolerant),
    )


def handle(hash: str, parent: str, kind: str) -> str:
    """How an artefact is written inside the digest of an operation."""
    return HANDLE % (hash, parent, kind, kind)


def operation(function_hash: str, operands: Mapping[str, str]) -> str:
    """operands: input name -> handle()."""
    return digest(OPERATION, function_hash, *(OPERAND % (k, operands[k]) for k in sorted(operands)))


def parametric_operation(function_hash: str, operands: Mapping[str, str]) -> str:
    return digest(function_hash, *(OPERAND % (k, operands[k]) for k in sorted(operands)))


def parametric(outputs: Mapping[str, str]) -> str:
    return digest(PARAMETRIC, *(PARAMETRIC_OUTPUT % (k, outputs[k]) for k in sorted(outputs)))


# ------------------------------------------------------------------ the same over columns
def constant_column(kind: str, data: Column) -> Column:
    return F.sha1(F.concat(F.lit(ARTEFACT + CONSTANT + KIND % kind), data))


def variable_column(kind: str, operation_hash: Column, name: str) -> Column:
    before, after = PARENT.split("%s")
    return F.sha1(F.concat(F.lit(ARTEFACT + VARIABLE + KIND % kind + before), operation_hash, F.lit(after + NAME % name)))


def handle_column(hash: Column, parent: Column, kind: str) -> Column:
    a, b, c, d, e = HANDLE.split("%s")
    return F.concat(F.lit(a), hash, F.lit(b), parent, F.lit(c + kind + d + kind + e))


def operation_column(function_hash: str, operands: Mapping[str, Column]) -> Column:
    parts: list[Column] = [F.lit(OPERATION + function_hash)]
    for k in sorted(operands):
        parts += [F.lit(OPERAND.split("%s, hash")[0] + k + ", hash="), operands[k]]
    return F.sha1(F.concat(*parts))


def short(hash: Column) -> Column:
    return F.substring(hash, 1, SHORT)


def shard_path(hash: Column) -> Column:
    return F.concat_ws("/", F.substring(hash, 1, 2), F.substring(hash, 3, 40))
