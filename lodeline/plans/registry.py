"""Named operators with declared schemas, scopes, a call budget and a ledger."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LEDGER = "call_id long, operator string, input_hash string, status string, started double, latency_ms long, error string"


@dataclass(frozen=True)
class Operator:
    """A function from frames to a frame, the columns it needs of each, and the schema it gives."""

    name: str
    run: Callable[..., DataFrame]
    needs: dict[str, T.StructType] = field(default_factory=dict)
    gives: T.StructType | None = None

    @property
    def namespace(self) -> str:
        return self.name.split(".", 1)[0]


class SchemaMismatch(ValueError):
    """A frame lacks a declared column, or has it with another type."""


def require(df: DataFrame, schema: T.StructType, what: str) -> None:
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: {f.dataType.simpleString()} is declared, {have[f.name].simpleString() if f.name in have else 'nothing'} is there" for f in schema.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise SchemaMismatch(f"{what}: " + "; ".join(wrong))


def canonical_hash(payload: object) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, default=str).encode()).hexdigest()


class Registry:
    """Operators by full name. ``call`` checks schemas before and after, counts against the budget, and keeps a ledger."""

    def __init__(self, operators: dict[str, Operator] | None = None, budget: int = 200):
        self._operators = dict(operators or {})
        self.budget, self.calls = budget, []

    def register(self, operator: Operator) -> None:
        if operator.name in self._operators:
            raise ValueError(f"{operator.name} is registered already")
        self._operators[operator.name] = operator

    def get(self, name: str) -> Operator:
        if name not in self._operators:
            raise KeyError(f"no operator {name}")
        return self._operators[name]

    def names(self, namespace: str | None = None) -> list[str]:
        return sorted(n for n, o in self._operators.items() if namespace in (None, o.namespace))

    def scoped(self, allowed: list[str]) -> Registry:
        """A registry of some of the operators; an unknown name is an error."""
        return Registry({name: self.get(name) for name in allowed}, self.budget)

    def __len__(self) -> int:
        return len(self._operators)

    def call(self, name: str, frames: dict[str, DataFrame], **parameters) -> DataFrame:
        """Run an operator lazily; only its plan is made, so a call costs no job."""
        if len(self.calls) >= self.budget:
            raise RuntimeError(f"the budget of {self.budget} calls is spent")
        key = canonical_hash({"operator": name, "parameters": parameters, "frames": {k: f.schema.json() for k, f in frames.items()}})
        began, status, error = time.time(), "ok", None
        try:
            operator = self.get(name)
            for frame, schema in operator.needs.items():
                if frame not in frames:
                    raise SchemaMismatch(f"{name} needs the frame {frame}")
                require(frames[frame], schema, f"{name}, {frame}")
            out = operator.run(**frames, **parameters)
            if operator.gives is not None:
                require(out, operator.gives, f"{name}, result")
            return out
        except Exception as e:
            status, error = "failed", f"{type(e).__name__}: {e}"
            raise
        finally:
            self.calls.append((len(self.calls) + 1, name, key, status, began, int((time.time() - began) * 1000), error))

    def ledger(self, spark: SparkSession) -> DataFrame:
        """One row a call."""
        return spark.createDataFrame(self.calls, LEDGER)
