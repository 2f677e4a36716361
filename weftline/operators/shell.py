"""External programs over rows: each row gets a folder, its files, and the commands."""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Ran:
    """What a run left behind; a declared file that is not there is None."""

    files: dict[str, bytes | None]
    stdouts: list[bytes] = field(default_factory=list)
    stderrs: list[bytes] = field(default_factory=list)
    returncodes: list[int] = field(default_factory=list)


def run(commands: Sequence[str], inputs: Mapping[str, bytes | None], outputs: Sequence[str], env: Mapping[str, str] | None = None, timeout: float | None = None) -> Ran:
    """All commands in turn, whatever the earlier ones returned, in a folder that is removed after.

    Inputs that are None are not written. Folders in file names are made.
    """
    with tempfile.TemporaryDirectory() as folder:
        for name, data in inputs.items():
            if data is not None:
                place = os.path.join(folder, name)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place, "wb") as f:
                    f.write(data)
        for name in outputs:
            os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
        out = Ran({})
        for command in commands:
            done = subprocess.run(command, shell=True, cwd=folder, env={**os.environ, **(env or {})}, capture_output=True, timeout=timeout)
            out.stdouts.append(done.stdout)
            out.stderrs.append(done.stderr)
            out.returncodes.append(done.returncode)
        for name in outputs:
            place = os.path.join(folder, name)
            out.files[name] = open(place, "rb").read() if os.path.isfile(place) else None
        return out


SCHEMA = "files map<string,binary>, stdouts array<binary>, stderrs array<binary>, returncodes array<int>, missing array<string>, error struct<kind:string,source:string,details:string>"
ADDED = ["files", "stdouts", "stderrs", "returncodes", "missing", "error"]


def over_rows(df: DataFrame, commands: Sequence[str], inputs: Mapping[str, str], outputs: Sequence[str] = (), env: Mapping[str, str] | None = None, timeout: float | None = None) -> DataFrame:
    """Runs ``commands`` for each row; ``inputs`` maps file names to string or binary columns.

    Adds files, stdouts, stderrs, returncodes, missing: declared outputs that were not made, and error.
    A return code other than 0 is data. A row whose commands take longer than ``timeout`` seconds has
    nothing but the error JobTimedOut, with all outputs missing.
    """
    kept = df.schema

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for _, row in batch.iterrows():
                given = {name: v.encode() if isinstance(v, str) else (None if v is None else bytes(v)) for name, v in ((n, row[c]) for n, c in inputs.items())}
                try:
                    ran, error = run(commands, given, outputs, env, timeout), None
                except subprocess.TimeoutExpired as late:
                    ran, error = Ran(dict.fromkeys(outputs)), {"kind": "JobTimedOut", "source": "shell", "details": str(late)}
                rows.append(({k: v for k, v in ran.files.items() if v is not None}, ran.stdouts, ran.stderrs, ran.returncodes, [k for k, v in ran.files.items() if v is None], error))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=ADDED)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + SCHEMA
    return df.mapInPandas(each, schema)


def only(name: str):
    """The single entry of stdouts, stderrs or returncodes; a null where several commands ran is an error."""
    return F.when(F.size(name) == 1, F.element_at(name, 1)).otherwise(F.raise_error(F.lit(f"{name}: several commands ran")))
