"""References to records that do not exist.

Distinct non-null foreign keys are anti-joined with the parent keys; what is left is joined back to
the referring records. Only distinct keys meet the parents, so a key that holds a third of all rows
costs one row there. The join back is salted, so such a key is spread over `salts` tasks.

Defined results: NULL in any part of a foreign key is no reference; a record that stands twice counts
once; an empty parent table makes every reference an orphan; an empty child table gives no rows.
Columns of the inputs beside those named are never read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """A field that refers to another table.

    child, key: the referring rows and the columns of its foreign key. parents: tables of which any
    may hold the key, each with as many columns, in order. record: what names the referring record.
    period: the period it is reported under; NULL becomes `none`.
    """

    field: str
    child: DataFrame
    key: Sequence[Column]
    parents: Sequence[DataFrame]
    record: Column
    period: Column


def _names(n: int) -> list[str]:
    return [f"_k{i}" for i in range(n)]


def orphan_records(ref: Reference, salts: int = 8) -> DataFrame:
    """ref_field, record_key, period: one row per referring record without target."""
    names = _names(len(ref.key))
    rows = ref.child.select(
        *[k.cast("string").alias(n) for k, n in zip(ref.key, names)],
        ref.record.cast("string").alias("record_key"),
        F.coalesce(ref.period.cast("string"), F.lit("none")).alias("period"),
    ).na.drop(subset=names)
    missing = rows.select(*names).distinct()
    for parent in ref.parents:
        keys = parent.toDF(*[f"_p{i}" for i in range(len(parent.columns))])
        keys = keys.select(*[F.col(f"_p{i}").cast("string").alias(n) for i, n in enumerate(names[: len(parent.columns)])]).na.drop().distinct()
        missing = missing.join(keys, names[: len(parent.columns)], "left_anti")
    if salts > 1:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("record_key"), F.lit(salts)))
        missing = missing.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        names = [*names, "_salt"]
    return rows.join(missing, names, "left_semi").select(F.lit(ref.field).alias("ref_field"), "record_key", "period").distinct()


def looked_up(rows: DataFrame, values: DataFrame, key: str, salts: int = 8) -> DataFrame:
    """The rows with the columns of `values`, one row per key there; salted, so rows of one key are spread over `salts` tasks. NULL keys find nothing."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    copies = values.where(F.col(key).isNotNull()).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def orphans(refs: Sequence[Reference], salts: int = 8) -> DataFrame:
    """The rows of orphan_records for every reference."""
    return reduce(DataFrame.unionByName, [orphan_records(r, salts) for r in refs])


def orphan_report(refs: Sequence[Reference]) -> DataFrame:
    """ref_field, period, n_keys, n_records: distinct missing keys and referring records per field and period."""

    def one(ref: Reference) -> DataFrame:
        names = _names(len(ref.key))
        rows = ref.child.select(
            *[k.cast("string").alias(n) for k, n in zip(ref.key, names)],
            ref.record.cast("string").alias("record_key"),
            F.coalesce(ref.period.cast("string"), F.lit("none")).alias("period"),
        ).na.drop(subset=names)
        # counted per key and period first, so the join moves one row per pair
        counted = rows.distinct().groupBy(*names, "period").agg(F.count(F.lit(1)).alias("n"))
        missing = counted.select(*names).distinct()
        for parent in ref.parents:
            n = len(parent.columns)
            keys = parent.toDF(*names[:n]).select(*[F.col(x).cast("string").alias(x) for x in names[:n]]).na.drop().distinct()
            missing = missing.join(keys, names[:n], "left_anti")
        return (
            counted.join(missing, names)
            .groupBy("period")
            .agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_records"))
            .select(F.lit(ref.field).alias("ref_field"), "period", "n_keys", "n_records")
        )

    return reduce(DataFrame.unionByName, [one(r) for r in refs])
