"""Operators on stored tables: first and latest rows, idempotent and updating writes as new snapshots, paging.

Parquet tables know no update: a write makes the next snapshot of a table from the last one, by one
writer at a time, which also stands in for row locks and fenced claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def first_by(df: DataFrame, keys: list, *order: Column) -> DataFrame:
    """One row of each key: the first in this order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def exists(df: DataFrame, where: Column) -> DataFrame:
    """One row (found): whether a row meets the condition; the scan ends with the first one."""
    return df.where(where).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def by_key(df: DataFrame, **key) -> DataFrame:
    """The row of a natural key, whatever its tenant; a null in the key finds nothing."""
    for name, value in key.items():
        df = df.where(F.lit(False) if value is None else F.col(name) == value)
    return df.limit(1)


def get_or_create(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table's row of each wanted key, or the new row where it has none; to be appended where ``created``."""
    wanted = rows.dropDuplicates(keys)
    held = table.join(wanted.select(*keys), keys, "left_semi").select(*rows.columns).withColumn("created", F.lit(False))
    return held.unionByName(wanted.join(table.select(*keys).distinct(), keys, "left_anti").withColumn("created", F.lit(True)))


def update_from(table: DataFrame, rows: DataFrame, keys: list[str], only_missing: bool = True) -> DataFrame:
    """The next snapshot with the other columns of ``rows`` (one row a key) put into the table's rows of the key:
    where those are null, or everywhere."""
    values = [c for c in rows.columns if c not in keys]
    joined = table.join(rows.select(*(F.col(c).alias(f"__{c}") for c in rows.columns)), [table[k].eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    new = {c: F.coalesce(*([table[c], F.col(f"__{c}")] if only_missing else [F.col(f"__{c}"), table[c]])) for c in values}
    return joined.select(*(new[c].alias(c) if c in new else table[c] for c in table.columns))


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str], live: Column | None = None) -> DataFrame:
    """Rows whose key the table (or its live part) doesn't hold, one for each key; to be appended."""
    held = table if live is None else table.where(live)
    return rows.dropDuplicates(keys).join(held.select(*keys).distinct(), keys, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The next snapshot: ``rows`` replace the table's rows of the same key."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def rewrite(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """The next snapshot with these columns set where the condition is true."""
    return table.withColumns({name: F.when(where, value).otherwise(F.col(name)) for name, value in values.items()})


def tombstone(grants: DataFrame, where: Column, at: Column) -> DataFrame:
    return rewrite(grants, where & F.col("revoked_at").isNull(), revoked_at=at)


def delete_cascade(tables: dict[str, DataFrame], parent: str, where: Column, children: dict[str, str]) -> dict[str, DataFrame]:
    """Next snapshots without the parent's rows and without their children; ``children``: table -> its parent column."""
    gone = tables[parent].where(where).select("org_id", F.col("id").alias("__id"))
    out = {parent: tables[parent].where(~F.coalesce(where, F.lit(False)))}
    for name, column in children.items():
        child = tables[name]
        out[name] = child.join(gone, (child["org_id"] == gone["org_id"]) & (child[column] == gone["__id"]), "left_anti")
    return tables | out


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def optional_filter(df: DataFrame, **equal) -> DataFrame:
    """Equalities on the columns whose value isn't None."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def every_nth(df: DataFrame, order: list[Column], n: int, limit: int | None = None) -> DataFrame:
    """Strided sample in an order: the first row, and every n-th after it; with ``limit`` so many of them.

    A row's rank is its place in its range partition, written once, and the rows of the partitions before it:
    only the partitions' counts, one row each, come together in one task."""
    here = F.struct(F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("place"))
    ordered = checkpointed(df.orderBy(*order).withColumn("__at", here))
    sizes = ordered.groupBy(F.col("__at.part").alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")).alias("__before"))
    ranked = ordered.join(before, F.col("__at.part") == F.col("__part")).withColumn("__rank", F.col("__before") + F.col("__at.place"))
    picked = ranked.where((F.col("__rank") % n == 0) & (F.lit(True) if limit is None else F.col("__rank") < n * limit))
    return picked.select(*df.columns)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def erasure_certificate(tables: dict[str, DataFrame], org) -> DataFrame:
    """(table_name, deleted): rows of a tenant in each table."""
    parts = [t.where(F.col("org_id") == org).agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table_name"), "deleted") for name, t in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def erased(tables: dict[str, DataFrame], org) -> dict[str, DataFrame]:
    return {name: t.where(F.col("org_id") != org) for name, t in tables.items()}
