"""Column roles of an experiment table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class ExperimentSpec:
    """Names the columns every operator works on; nothing is hard-coded elsewhere.

    ``leak`` holds post-treatment columns, which must never become features.
    """

    features: tuple[str, ...] = tuple(f"f{i}" for i in range(12))
    treatment: str = "treatment"
    outcomes: tuple[str, ...] = ("visit", "conversion")
    leak: tuple[str, ...] = ("exposure",)
    unit_id: str = "unit_id"

    def __post_init__(self) -> None:
        overlap = set(self.features) & {self.treatment, *self.outcomes, *self.leak, self.unit_id}
        if overlap:
            raise ValueError(f"columns used as a feature and in another role: {sorted(overlap)}")

    @property
    def primary_outcome(self) -> str:
        """The outcome rankings and strata use; the last one listed is the rare one."""
        return self.outcomes[-1]

    @property
    def contract(self) -> list[str]:
        """Columns of the processed table, in order, without the unit key."""
        return [*self.features, self.treatment, *self.outcomes]

    def raw_schema(self) -> T.StructType:
        """Explicit schema of the raw CSV: features, treatment, outcomes (rarest first), leak."""
        ints = [self.treatment, *reversed(self.outcomes), *self.leak]
        return T.StructType(
            [T.StructField(c, T.DoubleType()) for c in self.features]
            + [T.StructField(c, T.IntegerType()) for c in ints]
        )

    def processed_types(self) -> dict[str, T.DataType]:
        """Expected type of every contract column."""
        return {
            **{c: T.DoubleType() for c in self.features},
            **{c: T.IntegerType() for c in (self.treatment, *self.outcomes)},
        }
