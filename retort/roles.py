"""Which columns of a table mean what."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame

CANONICAL, LOG, VALID = "Canonical SMILES", "Processing Log", "Is Valid"
ROW = "__row_id"  #: hidden order of rows, for operators that depend on it


@dataclass(frozen=True)
class Roles:
    smiles: str | None = None
    cas: str | None = None
    name: str | None = None
    target: str | None = None
    unit: str | None = None
    inchikey: str | None = None
    id: str | None = None
    preprocessed: bool = False

    def __post_init__(self) -> None:
        used = list(self.columns().values())
        twice = sorted({c for c in used if used.count(c) > 1})
        if twice:
            warnings.warn(f"columns with several roles: {', '.join(twice)}", stacklevel=3)

    def columns(self) -> dict[str, str]:
        """role: column, for the roles that are set."""
        return {f.name: v for f in fields(self) if f.name != "preprocessed" and (v := getattr(self, f.name))}

    def check(self, df: DataFrame, spare: tuple[str, ...] = ()) -> None:
        """Raise KeyError if a column with a role is missing."""
        missing = {r: c for r, c in self.columns().items() if c not in df.columns and r not in spare}
        if missing:
            raise KeyError(f"missing columns: {missing}")

    @property
    def structure(self) -> str | None:
        """The column that structure operators read."""
        return CANONICAL if self.preprocessed else self.smiles

    def with_(self, **changes) -> Roles:
        return replace(self, **changes)
