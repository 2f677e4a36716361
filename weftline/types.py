"""The types that users name in annotations and checks."""

from weftline.model import Artefact, ArtefactStatus, Encoding, Error, ErrorKind, Function, How, Operation, Options, RunStatus, ShellOutput, UnwrapError

__all__ = ["Artefact", "ArtefactStatus", "Encoding", "Error", "ErrorKind", "Function", "How", "Operation", "Options", "RunStatus", "ShellOutput", "UnwrapError"]
