"""weftline: lazy, provenance-tracked data workflows as Spark plans."""

from weftline import debug, dynamic, parametric, types, utils
from weftline.api import execute, get, morph, put, py, reduce, reset, sac, shell, subdag, take, takeout, template, wait_for
from weftline.flow import Flow, ManagedFlow, options
from weftline.model import Artefact, Encoding, Error, ErrorKind, Operation, Options, ShellOutput, UnwrapError, match, unwrap

Fun, ManagedFun = Flow, ManagedFlow

__all__ = [
    "Artefact", "Encoding", "Error", "ErrorKind", "Flow", "Fun", "ManagedFlow", "ManagedFun", "Operation", "Options", "ShellOutput", "UnwrapError",
    "debug", "dynamic", "execute", "get", "match", "morph", "options", "parametric", "put", "py", "reduce", "reset", "sac", "shell", "subdag", "take", "takeout", "template", "types", "unwrap", "utils", "wait_for",
]
