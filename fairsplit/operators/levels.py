"""Categorical covariates of any width: levels as a table, designs as sparse rows.

A level's number is its place in the sorted order of its covariate's levels. The
distinct levels are counted with map-side combining, cut into ranges and numbered within
each, so no task holds all of them and none reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StatisticsError
from ..functions.columns import as_double, quoted, require_columns
from ..plans.attach import join_levels
from ..plans.storage import materialize
from .design import is_categorical
from .logistic import BROADCAST_LEVELS

_IN_PARTITION = (1 << 33) - 1


def numbered_levels(rows: DataFrame, value: Column, treated: Column | None = None) -> DataFrame:
    """Stored table ``(k, level, n, n_treated)``: the distinct values that are not missing, numbered from 0 in order."""
    hit = F.count_if(treated) if treated is not None else F.lit(0).cast("long")
    counted = rows.select(value.cast("string").alias("level"), *([treated.alias("_t")] if treated is not None else [])) \
        .where("level IS NOT NULL").groupBy("level").agg(
            F.count(F.lit(1)).alias("n"), (F.count_if("_t") if treated is not None else hit).alias("n_treated"))
    ranged = counted.repartitionByRange("level").sortWithinPartitions("level").select(
        "level", "n", "n_treated", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias("place"))
    placed = materialize(ranged, "levels")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("m")).select(
        "part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "part").select(
        (F.col("before") + F.col("place")).alias("k"), "level", "n", "n_treated")


@dataclass
class Levels:
    """A numbered covariate: its table, how many levels it has, and the most rows of one."""

    table: DataFrame
    size: int
    total: int
    largest: int

    @classmethod
    def of(cls, rows: DataFrame, value: Column, treated: Column | None = None) -> Levels:
        table = numbered_levels(rows, value, treated)
        row = table.agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.max("n").alias("largest")).first()
        return cls(table, row["size"], row["total"] or 0, row["largest"] or 0)

    def number(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        """``rows`` with the level's number in column ``name``; rows whose value is missing have none."""
        keyed = rows.withColumn("_level", value.cast("string"))
        names = self.table.select(F.col("level").alias("_level"), F.col("k").alias(name), "n")
        if self.size <= BROADCAST_LEVELS:
            return keyed.join(F.broadcast(names.drop("n")), "_level", "left").drop("_level")
        absent = keyed.where("_level IS NULL").withColumn(name, F.lit(None).cast("long"))
        found = join_levels(keyed.where("_level IS NOT NULL"), names, "_level", "n", self.total, self.largest)
        return found.unionByName(absent).drop("_level")


def sparse_design(df: DataFrame, covariates: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """A design of any width as sparse rows, and the table of its features.

    The rows have ``keep``, ``indices`` (ascending) and ``values``; the features have ``index`` and ``feature``. Indices follow
    the covariates in order: a number takes one, a category one per level but the first in sorted order, whose rows have no
    cell of it. Numbers are always present, be they zero; a row with a missing covariate has null cells.
    """
    if not covariates:
        raise StatisticsError("A design matrix needs at least one covariate.")
    require_columns(df, covariates, "covariate")
    clash = {"indices", "values"} & set(keep)
    if clash:
        raise StatisticsError(f"keep has names of the result: {sorted(clash)}")
    rows, cells, features, offset = df, [], [], 0
    spark, missing = df.sparkSession, F.lit(False)
    for i, name in enumerate(covariates):
        if is_categorical(df, name):
            value, slot = F.col(quoted(name)).cast("string"), f"_k{i}"
            levels = Levels.of(df, value)
            rows = levels.number(rows, value, slot)
            at, one = F.lit(offset - 1) + F.col(slot), F.lit(1.0)
            missing = missing | F.col(slot).isNull()
            cells.append(F.when(F.col(slot) > 0, F.struct(at.cast("long").alias("i"), one.alias("v"))))
            features.append(levels.table.where("k > 0").select(
                (F.col("k") + F.lit(offset - 1)).alias("index"), F.concat(F.lit(f"{name}_"), "level").alias("feature")))
            offset += max(0, levels.size - 1)
        else:
            number = as_double(df, name)
            missing = missing | number.isNull()
            cells.append(F.struct(F.lit(offset).cast("long").alias("i"), number.alias("v")))
            features.append(spark.createDataFrame([(offset, name)], "index long, feature string"))
            offset += 1
    # Cells are in the order of the covariates, hence of the indices.
    row = F.when(~missing, F.array_compact(F.array(*cells)))
    out = rows.withColumn("_cells", row).select(
        *[F.col(quoted(c)) for c in keep], F.transform("_cells", lambda c: c["i"]).alias("indices"),
        F.transform("_cells", lambda c: c["v"]).alias("values"))
    named = features[0]
    for part in features[1:]:
        named = named.unionByName(part)
    return out, named
