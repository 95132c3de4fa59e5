"""Audit log and undo."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "Step string, Timestamp string, `Rows Before` long, `Rows After` long, Delta string, Details string"
DEPTH = 5  #: states kept for undo


def delta(before: int | None, after: int) -> str:
    if before is None:
        return f"+{after}"
    return f"+{after - before}" if after > before else str(after - before)


@dataclass(frozen=True)
class Audit:
    rows: tuple[tuple, ...] = field(default=())

    def record(self, step: str, before: int | None, after: int, details: str = "") -> Audit:
        row = (step, datetime.now().strftime("%H:%M:%S"), before, after, delta(before, after), details)
        return Audit((*self.rows, row))

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), COLUMNS)


@dataclass(frozen=True)
class History:
    states: tuple[Any, ...] = field(default=())

    def push(self, state: Any) -> History:
        return History((*self.states, state)[-DEPTH:])

    def pop(self) -> tuple[Any, History] | None:
        return (self.states[-1], History(self.states[:-1])) if self.states else None
