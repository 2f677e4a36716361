"""Named plans: commit a builder with its inputs, recall it with some of them changed."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from weftline import identity


@dataclass(frozen=True)
class NamedPlan:
    name: str
    build: Callable[..., DataFrame]
    inputs: Mapping[str, Any]

    @property
    def hash(self) -> str:
        """Equal for equal builders and input names, whatever the name and the values."""
        made = identity.parametric_operation(identity.digest(self.build.__qualname__), {k: k for k in self.inputs})
        return identity.parametric({"out": f"{made}:out"})


class Plans:
    """A registry; the last commit of a name wins, and hashes stay valid."""

    def __init__(self) -> None:
        self._by_name: dict[str, NamedPlan] = {}
        self._by_hash: dict[str, NamedPlan] = {}

    def commit(self, name: str, build: Callable[..., DataFrame], **inputs: Any) -> str:
        plan = NamedPlan(name, build, inputs)
        self._by_name[name] = self._by_hash[plan.hash] = plan
        return plan.hash

    def recall(self, name_or_hash: str, **inputs: Any) -> DataFrame:
        plan = self._by_name.get(name_or_hash) or self._by_hash.get(name_or_hash)
        if plan is None:
            raise KeyError(name_or_hash)
        unknown = set(inputs) - set(plan.inputs)
        if unknown:
            raise AttributeError(f"{plan.name} has no input {', '.join(sorted(unknown))}")
        return plan.build(**{**plan.inputs, **inputs})

    def commit_sql(self, name: str, spark: SparkSession, text: str, **inputs: Any) -> str:
        """A plan given as SQL with named parameters (:name)."""

        def build(**args: Any) -> DataFrame:
            return spark.sql(text, args=args)

        build.__qualname__ = text
        return self.commit(name, build, **inputs)
