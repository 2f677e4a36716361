"""What a workflow is made of: values and their errors, handles, functions, operations, options."""

from __future__ import annotations

import enum
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, replace
from typing import Any, Generic, TypeVar

from weftline import identity

T = TypeVar("T")


class Encoding(str, enum.Enum):
    json = "json"
    blob = "blob"


class ArtefactStatus(int, enum.Enum):
    """Over no_data: there is something to read."""

    deleted = -2
    not_found = -1
    no_data = 0
    done = 1
    const = 2
    error = 3
    linked = 4


class RunStatus(int, enum.Enum):
    """Over 0: what depends on the operation may go on."""

    subdag_ready = -5
    delayed = -3
    unmet_dependencies = -2
    not_ready = -1
    executed = 1
    using_cached = 2
    input_error = 4


class How(int, enum.Enum):
    python = 0
    shell = 1
    subdag = 2


class ErrorKind(str, enum.Enum):
    NotFound = "NotFound"
    Mismatch = "Mismatch"
    UnresolvedLink = "UnresolvedLink"
    DataNotFound = "DataNotFound"
    WrongType = "WrongType"
    JSONEncodingError = "JSONEncodingError"
    JSONDecodingError = "JSONDecodingError"
    UnknownEncodingError = "UnknownEncodingError"
    MissingOutput = "MissingOutput"
    MissingInput = "MissingInput"
    ExceptionRaised = "ExceptionRaised"
    JobTimedOut = "JobTimedOut"
    NoErrorData = "NoErrorData"
    KilledBySignal = "KilledBySignal"


@dataclass(frozen=True)
class Error:
    """A value that could not be had. source: the operation where it arose."""

    kind: ErrorKind
    source: str | None = None
    details: str | None = None


class UnwrapError(Exception):
    """An error was unwrapped."""


def unwrap(result: Any) -> Any:
    if isinstance(result, Error):
        raise UnwrapError(f"{result.kind.value} from {result.source}\n{result.details or ''}")
    return result


def match(result: Any, some: Callable[[Any], Any], none: Callable[[Error], Any]) -> Any:
    return none(result) if isinstance(result, Error) else some(result)


@dataclass(frozen=True)
class Artefact(Generic[T]):
    """A pointer to one value, computed or not."""

    hash: str
    parent: str
    kind: Encoding

    @property
    def handle(self) -> str:
        return identity.handle(self.hash, self.parent, self.kind.value)


@dataclass(frozen=True)
class Function:
    """A wrapped command or callable. body does not enter the hash: a function is known by its name."""

    how: How
    what: str
    inp: Mapping[str, Encoding]
    out: Mapping[str, Encoding]
    body: Any = None
    error_tolerant: bool = False
    hash: str = field(init=False)

    def __post_init__(self) -> None:
        kinds = [{k: e.value for k, e in x.items()} for x in (self.inp, self.out)]
        object.__setattr__(self, "hash", identity.function(self.how.value, self.what, *kinds, self.error_tolerant))


@dataclass(frozen=True)
class Options:
    """How to run; none of it enters a hash.

    queue is a scheduler pool; reset computes anew what is cached; evaluate=False makes anything that
    is not cached a RuntimeError. ttl, result_ttl and failure_ttl are kept for callers that set them:
    values stay until they are reset.
    """

    timeout: float = -1
    queue: str = "default"
    distributed: bool = True
    reset: bool = False
    evaluate: bool = True
    ttl: int = 86400
    result_ttl: int = 60
    failure_ttl: int = 86400

    def pack(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def unpack(cls, packed: Mapping[str, Any]) -> Options:
        return cls(**packed)

    def with_(self, **changes: Any) -> Options:
        return replace(self, **changes)


@dataclass(frozen=True)
class Operation:
    """A function applied to artefacts; inp and out map names to hashes."""

    hash: str
    function: str
    inp: Mapping[str, str]
    out: Mapping[str, str]
    options: Options


@dataclass(frozen=True)
class ShellOutput:
    """The outputs of a shell operation; the singular accessors need exactly one command."""

    op: Operation
    out: Mapping[str, Artefact[bytes]]
    stdouts: tuple[Artefact[bytes], ...]
    stderrs: tuple[Artefact[bytes], ...]
    returncodes: tuple[Artefact[int], ...]

    @property
    def hash(self) -> str:
        return self.op.hash

    def _single(self, many: tuple) -> Artefact:
        if len(many) != 1:
            raise AttributeError(f"{len(many)} commands were given; use the plural")
        return many[0]

    @property
    def stdout(self) -> Artefact[bytes]:
        return self._single(self.stdouts)

    @property
    def stderr(self) -> Artefact[bytes]:
        return self._single(self.stderrs)

    @property
    def returncode(self) -> Artefact[int]:
        return self._single(self.returncodes)
