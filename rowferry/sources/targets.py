"""Target tables made from a contract, and rows let in by its constraints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..contracts import ContractError, ForeignKey, TableContract, TargetContract
from ..operators.projection import coerce_rows, empty_target
from ..operators.skew import spread_join
from ..operators.union import union_all
from .workspace import materialise

CREATED = "table_name string, wave int, position int, column_name string, data_type string, nullable boolean, is_primary_key boolean, ref_table string"
AUDIT = "_created"


def waves(contract: TargetContract) -> list[list[str]]:
    """Tables by dependence: those of a wave refer to tables of earlier waves only, or to themselves."""
    pending = {t.name: {fk.ref_table for fk in t.foreign_keys} - {t.name} for t in contract.tables}
    found: list[list[str]] = []
    while pending:
        ready = sorted(n for n, parents in pending.items() if not parents & pending.keys())
        if not ready:
            raise ContractError(f"foreign keys form a cycle among {sorted(pending)}")
        found.append(ready)
        pending = {n: parents for n, parents in pending.items() if n not in ready}
    return found


def create(spark: SparkSession, contract: TargetContract, root: str) -> DataFrame:
    """Creates every table of a contract empty, parents first, and an audit table of what was created, which comes back."""
    rows = []
    for number, names in enumerate(waves(contract)):
        for name in names:
            table = contract.table(name)
            empty_target(spark, table).write.parquet(f"{root}/{name}")
            refs = {fk.column: fk.ref_table for fk in table.foreign_keys}
            rows += [(name, number, i, c.name, c.data_type, c.nullable, c.primary_key, refs.get(c.name)) for i, c in enumerate(table.columns)]
    spark.createDataFrame(rows, CREATED).coalesce(1).write.parquet(f"{root}/{AUDIT}")
    return spark.read.schema(CREATED).parquet(f"{root}/{AUDIT}")


def stored(spark: SparkSession, contract: TargetContract, root: str, name: str) -> DataFrame:
    return spark.read.schema(empty_target(spark, contract.table(name)).schema).parquet(f"{root}/{name}")


def checked(rows: DataFrame, table: TableContract, present: DataFrame, parents: dict[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """Rows with an `errors` array: empty where NOT NULL, key and foreign keys hold.

    Of new rows with one key the first in `order` counts, if the table does not have the key; a null foreign key refers to nothing.
    """
    errors = [F.when(F.col(c.name).isNull(), F.lit(f"{c.name} is null")) for c in table.columns if not c.nullable or c.primary_key]
    pk = table.primary_key
    if pk is not None:
        taken = spread_join(rows, present.select(pk).distinct().withColumn("_taken", F.lit(True)), pk, "left")
        # Null keys are errors already; dealt by their other values they make no large group.
        alone = F.when(F.col(pk).isNull(), F.xxhash64(*order))
        rank = F.row_number().over(W.partitionBy(pk, alone).orderBy(*order))
        rows = taken.withColumn("_rank", rank)
        errors.append(F.when(F.col(pk).isNotNull() & (F.col("_taken").isNotNull() | (F.col("_rank") > 1)), F.lit(f"{pk} is there already")))
    for fk in table.foreign_keys:
        keys = parents[fk.ref_table].select(F.col(fk.ref_column).alias(fk.column)).distinct().withColumn(f"_has_{fk.column}", F.lit(True))
        rows = spread_join(rows, keys, fk.column, "left", list(order))
        errors.append(F.when(F.col(fk.column).isNotNull() & F.col(f"_has_{fk.column}").isNull(),
                             F.lit(f"{fk.column} has no row in {fk.ref_table}")))
    return rows.withColumn("errors", F.filter(F.array(*errors), lambda e: e.isNotNull())).drop(
        "_taken", "_rank", *[f"_has_{fk.column}" for fk in table.foreign_keys])


def _without_lost(rows: DataFrame, present: DataFrame, fk: ForeignKey, name: str, order: Sequence[str]) -> DataFrame:
    """Rows of a table that refers to itself, with an error also where the row referred to is not let in."""
    while True:
        good = rows.filter(F.size("errors") == 0)
        there = union_all(present.select(F.col(fk.ref_column).alias(fk.column)), good.select(F.col(fk.ref_column).alias(fk.column)))
        lost = spread_join(good.filter(F.col(fk.column).isNotNull()), there.distinct(), fk.column, "left_anti", list(order))
        lost = materialise(lost.select(F.col(fk.ref_column)).distinct().withColumn("_lost", F.lit(True)))
        if lost.isEmpty():
            return rows
        error = F.array(F.lit(f"{fk.column} has no row in {name}"))
        rows = materialise(rows.join(lost, fk.ref_column, "left").withColumn("errors", F.when(
            (F.size("errors") == 0) & F.col("_lost").isNotNull(), error).otherwise(F.col("errors"))).drop("_lost"))


def load(spark: SparkSession, contract: TargetContract, root: str, frames: dict[str, DataFrame], order: dict[str, Sequence[str]]) -> DataFrame:
    """Appends what the constraints allow, parents first. Returns (table_name, row, errors) of what they do not.

    A table that refers to itself may refer to rows it has or to good rows of the same load: what refers to a rejected row is
    rejected in turn, in as many rounds as the longest chain of such references has rows.
    """
    rejected = []
    for names in waves(contract):
        for name in names:
            if name not in frames:
                continue
            table = contract.table(name)
            typed = coerce_rows(frames[name], table)
            parents = {fk.ref_table: stored(spark, contract, root, fk.ref_table) for fk in table.foreign_keys}
            present = stored(spark, contract, root, name)
            columns = [c.name for c in table.columns]
            if name in parents:
                parents[name] = union_all(present.select(*columns), typed.select(*columns))
            rows = materialise(checked(typed, table, present, parents, order[name]))
            for fk in (fk for fk in table.foreign_keys if fk.ref_table == name):
                rows = _without_lost(rows, present, fk, name, order[name])
            rows.filter(F.size("errors") == 0).select(*columns).write.mode("append").parquet(f"{root}/{name}")
            rejected.append(rows.filter(F.size("errors") > 0).select(
                F.lit(name).alias("table_name"), F.to_json(F.struct(*columns)).alias("row"), "errors"))
    return union_all(*rejected)
