"""The row-wise operators on streams, and deduplication of streamed structures within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..chem.rules import Rules
from ..chem.standardize import Options
from ..functions.numbers import name
from ..operators.structure import preprocess, substructure_search
from ..roles import CANONICAL

__all__ = ["first_of_structure", "preprocess", "substructure_search"]


def first_of_structure(stream: DataFrame, smiles: str, time: str, delay: str, options: Options | None = None, rules: Rules | None = None) -> DataFrame:
    """Standardise a stream and pass on each valid structure once while it is within the watermark."""
    done = preprocess(stream.withWatermark(time, delay), smiles, options, rules)
    return done.where(name(CANONICAL).isNotNull()).dropDuplicatesWithinWatermark([CANONICAL])
