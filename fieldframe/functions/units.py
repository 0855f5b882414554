"""Unit systems and column scaling (PRJ9, PRJ10, PRJ46)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.functions import constants as C


@dataclass(frozen=True)
class UnitSystem:
    """CGS size of one code unit of length, mass, time, charge and temperature."""

    length: float = 1.0
    mass: float = 1.0
    time: float = 1.0
    charge: float = 1.0
    temperature: float = 1.0

    def __post_init__(self) -> None:
        if any(not math.isfinite(v) or v <= 0.0 for v in self.bases):
            raise ValueError("base scales must be positive and finite")

    @property
    def bases(self) -> tuple[float, ...]:
        return (self.length, self.mass, self.time, self.charge, self.temperature)

    def scale(self, dimension: str | tuple[int, ...]) -> float:
        """CGS value of one code unit of a derived dimension."""
        powers = C.DIMENSIONS[dimension] if isinstance(dimension, str) else dimension
        return math.prod(base ** power for base, power in zip(self.bases, powers))

    @staticmethod
    def from_magnetic_field(length: float, mass: float, time: float, field: float,
                            temperature: float = 1.0) -> "UnitSystem":
        """Charge scale implied by a field scale."""
        return UnitSystem(length, mass, time, length * mass / (time * time * field), temperature)

    @staticmethod
    def heliospheric() -> "UnitSystem":
        return UnitSystem(C.ASTRONOMICAL_UNIT, C.PROTON_MASS, C.DAY, C.ELEMENTARY_CHARGE)


def scale_columns(df: DataFrame, columns: list[str], factor: float, unit: str | None = None) -> DataFrame:
    """Multiply columns by a factor and label them with a unit (PRJ9)."""
    if not math.isfinite(factor) or factor <= 0.0:
        raise ValueError("the scale must be positive and finite")
    metadata = {"unit": unit} if unit else None
    return df.withColumns({
        name: (F.col(name) * float(factor)).alias(name, metadata=metadata) if metadata
        else F.col(name) * float(factor)
        for name in columns
    })


def convert_columns(df: DataFrame, columns: list[str], dimension, source: UnitSystem,
                    target: UnitSystem = UnitSystem(), unit: str | None = None) -> DataFrame:
    """Convert columns between unit systems; the default target is CGS (PRJ10)."""
    return scale_columns(df, columns, source.scale(dimension) / target.scale(dimension), unit)


def dimensionalize_field(df: DataFrame, coordinates: list[str], values: list[str],
                         coordinate_scale: float | None = None, value_scale: float | None = None,
                         keep_code_units: bool = False) -> DataFrame:
    """Scale a field snapshot by its stored CGS scales, or by overrides (PRJ9).

    Reads the ``coordinate_scale_cgs`` and ``value_scale_cgs`` columns of the rows, so
    snapshots of different scales can be mixed.
    """
    stored_c = F.lit(1.0) if keep_code_units else F.col("coordinate_scale_cgs")
    stored_v = F.lit(1.0) if keep_code_units else F.col("value_scale_cgs")
    c = F.lit(float(coordinate_scale)) if coordinate_scale is not None else stored_c
    v = F.lit(float(value_scale)) if value_scale is not None else stored_v
    out = df.withColumns({n: F.col(n) * c for n in coordinates} | {n: F.col(n) * v for n in values})
    labels = {
        "coordinate_unit": F.lit("code_length") if keep_code_units else
        F.when(c != 1.0, "cm").otherwise(F.col("coordinate_unit")),
        "value_unit": F.lit("code_value") if keep_code_units else
        F.when(v != 1.0, "cgs_value").otherwise(F.col("value_unit")),
    }
    return out.withColumns(labels | {"coordinate_scale_cgs": c, "value_scale_cgs": v})


def constants_table(spark: SparkSession) -> DataFrame:
    """Physical constants as a 13-row dimension (PRJ46)."""
    rows = [(s, n, *powers, v) for s, n, powers, v in C.PHYSICAL_CONSTANTS]
    return spark.createDataFrame(
        rows, "symbol string, name string, length int, mass int, time int, charge int, "
              "temperature int, value_cgs double")
