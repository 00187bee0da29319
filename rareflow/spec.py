"""Feature specification: which columns feed a model, in which order, and the label."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType


@dataclass(frozen=True)
class FeatureSpec:
    features: tuple[str, ...]
    label: str = "label"
    key: tuple[str, ...] = field(default=())

    def __post_init__(self):
        features = tuple(self.features)
        object.__setattr__(self, "features", features)
        object.__setattr__(self, "key", tuple(self.key))
        if not features or any(not isinstance(n, str) or not n for n in features):
            raise ValueError("features must be a non-empty list of column names")
        if len(set(features)) != len(features):
            raise ValueError("feature names must be distinct")
        if not isinstance(self.label, str) or not self.label:
            raise ValueError("the label must be a column name")
        if self.label in features:
            raise ValueError("the label cannot also be a feature")
        if len(set(self.key)) != len(self.key):
            raise ValueError("key columns must be distinct")

    @property
    def required(self) -> list[str]:
        return [*self.features, self.label]

    def with_key(self) -> list[str]:
        """Key, features and label without repeats (a key column may also be a feature)."""
        return list(dict.fromkeys([*self.key, *self.features, self.label]))

    def check_order(self, stored: list[str] | tuple[str, ...]) -> None:
        """A model stored with another feature order would score silently wrong."""
        if list(stored) != list(self.features):
            raise ValueError(f"feature order {list(stored)} does not match {list(self.features)}")


def check_schema(df: DataFrame, columns: list[str], name: str = "data") -> None:
    """The schema contract of a table: each of ``columns`` is there and holds numbers. No job is run."""
    kinds = {f.name: f.dataType for f in df.schema}
    faults = [f"{c}: {'missing' if c not in kinds else kinds[c].simpleString()}" for c in columns
              if not isinstance(kinds.get(c), NumericType)]
    if faults:
        raise ValueError(f"{name} needs numeric columns; faulty are {', '.join(faults)}")
