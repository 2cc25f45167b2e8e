"""Workflows: named steps over DataFrames. Rows that a check turns away are kept aside, and the named outputs are returned."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Step:
    """name, and what it makes of a DataFrame; with ``check`` (a condition on what it made) rows that fail go no further."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    check: Column | None = None


@dataclass
class Outcome:
    result: DataFrame
    outputs: dict[str, DataFrame] = field(default_factory=dict)
    rejected: dict[str, DataFrame] = field(default_factory=dict)


def run(rows: DataFrame, steps: list[Step], outputs: tuple[str, ...] = ()) -> Outcome:
    if unknown := set(outputs) - {s.name for s in steps}:
        raise ValueError(f"no such steps: {sorted(unknown)}")
    done = Outcome(rows)
    for s in steps:
        made = s.apply(done.result)
        if s.check is not None:
            from pyspark.sql import functions as F

            fine = F.coalesce(s.check, F.lit(False))
            done.rejected[s.name] = made.where(~fine)
            made = made.where(fine)
        done.result = made
        if s.name in outputs:
            done.outputs[s.name] = made
    return done
