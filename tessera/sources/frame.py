"""The modelling table: a DataFrame with declared features, label and row order.

NULL is missing for every kind of feature. ``ingest`` turns NaN into NULL; a
sentinel for missing categories can be named. Row order is explicit: ``rid`` is
a dense 0-based number, and nothing depends on the order of a DataFrame.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.staging import Stage, shuffle_partitions

RID, LABEL, WEIGHT = "rid", "label", "weight"
NUMBERS = {"double", "float", "int", "bigint", "smallint", "tinyint"}


class Kind(Enum):
    NUMERIC = "numeric"
    BOUNDED = "bounded"
    HIGH_CARD = "high_card"


@dataclass(frozen=True)
class Feature:
    name: str
    kind: Kind


class Schema:
    """Features in order; the order breaks ties between equal splits."""

    def __init__(self, names: list[str], kinds: list[Kind]):
        if len(names) != len(kinds):
            raise ValueError(f"{len(names)} names and {len(kinds)} kinds")
        if len(set(names)) != len(names):
            raise ValueError("feature names repeat")
        self.features = tuple(Feature(n, k) for n, k in zip(names, kinds))

    def __iter__(self):
        return iter(self.features)

    def __len__(self) -> int:
        return len(self.features)

    def of(self, kind: Kind) -> list[str]:
        return [f.name for f in self.features if f.kind is kind]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]


def ingest(df: DataFrame, schema: Schema, label: str | Column, missing_category: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Features, label and unit weights in one form; raises on types that don't fit."""
    kinds = dict(df.dtypes)
    columns = []
    for f in schema:
        if f.name not in kinds:
            raise ValueError(f"no column {f.name}")
        value = F.col(f.name)
        if f.kind is Kind.NUMERIC:
            if kinds[f.name] not in NUMBERS and not kinds[f.name].startswith("decimal"):
                raise ValueError(f"{f.name} is {kinds[f.name]}, not a number")
            value = value.cast("double")
            value = F.when(~F.isnan(value), value)
        else:
            if kinds[f.name] in ("double", "float"):
                raise ValueError(f"{f.name} is {kinds[f.name]}, not a category")
            if missing_category is not None and kinds[f.name] in NUMBERS:
                value = F.when(value != missing_category, value)
        columns.append(value.alias(f.name))
    y = F.col(label) if isinstance(label, str) else label
    y = y.cast("int")
    checked = F.when(y.isin(0, 1), y).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("int"))
    return df.select(*keep, *columns, checked.alias(LABEL), F.lit(1.0).alias(WEIGHT))


def with_row_numbers(df: DataFrame, *order: str | Column, name: str = RID) -> DataFrame:
    """df with a dense 0-based number in the given order.

    Rows are range-partitioned and written with their partition's number; a
    count per partition gives each its offset. No task sees more than a range.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).withColumn("_part", F.spark_partition_id())
    parts = Stage(df.sparkSession, "rows").put(parts, "ranges")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    sizes = sizes.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("_before"))
    number = F.row_number().over(W.partitionBy("_part").orderBy(*keys)) - 1
    return parts.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + number).drop("_part", "_before")


def round_half_away(x: float) -> int:
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def class_weights(df: DataFrame, pos_weight: float) -> DataFrame:
    """Weight of a row: pos_weight for label 1, else 1; earlier weights are replaced."""
    return df.withColumn(WEIGHT, F.when(F.col(LABEL) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))


def row_slice(df: DataFrame, lo: int, hi: int) -> DataFrame:
    return df.filter((F.col(RID) >= lo) & (F.col(RID) < hi))


def temporal_split(df: DataFrame, train_share: float) -> tuple[DataFrame, DataFrame]:
    """The first rows by number, and the rest; a share over 1 takes all."""
    n = df.count()
    cut = min(max(round_half_away(n * train_share), 0), n)
    return df.filter(F.col(RID) < cut), df.filter(F.col(RID) >= cut)


def raw_row(df: DataFrame, schema: Schema, rid: int) -> dict | None:
    """The feature values of one row, for the local scorer."""
    row = df.filter(F.col(RID) == rid).select(*schema.names).first()
    return row.asDict() if row else None
