"""Changes to tables as functions from DataFrames to DataFrames: what the table is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _winner(rows: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def upsert(table: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Insert new keys, update those whose columns differ (case-insensitively); ``change`` tells which."""
    new = incoming.select(F.col(key), *(F.col(c).alias(f"n_{c}") for c in columns), F.lit(1).alias("given"))
    both = table.withColumn("had", F.lit(1)).join(new, key, "full_outer")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.lower(F.col(c).cast("string")).eqNullSafe(F.lower(F.col(f"n_{c}").cast("string")))
    change = F.when(F.col("had").isNull(), "insert").when(F.col("given").isNull(), "keep").when(differs, "update").otherwise("same")
    out = both.withColumn("change", change)
    return out.select(key, *(F.when(F.col("change").isin("insert", "update"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in columns), "change")


def insert_missing(table: DataFrame, incoming: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Rows of ``incoming`` whose key the table lacks, one for each key, the first in ``order``."""
    fresh = _winner(incoming.withColumn("__k", key), [F.col("__k")], order)
    return fresh.join(table.select(key.alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def upsert_pois(table: DataFrame, incoming: DataFrame, margin: float = 0.001) -> DataFrame:
    """Incoming POIs once for each category and lower-cased name, with the stored id where one matches.

    Only stored POIs in the incoming ones' bounding box (with a margin in degrees) can match.
    """
    k = F.concat_ws("|", "category", F.lower(F.trim("name")))
    fresh = _winner(incoming.withColumn("k", k), [F.col("k")], [F.col("poi_id")])
    box = incoming.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    near = table.join(F.broadcast(box)).filter(F.col("lat").between(F.col("s") - margin, F.col("n") + margin) & F.col("lon").between(F.col("w") - margin, F.col("e") + margin))
    stored = _winner(near.withColumn("k", k), [F.col("k")], [F.col("poi_id")]).select("k", F.col("poi_id").alias("stored_id"))
    return fresh.join(stored, "k", "left").select("poi_id", "stored_id", "name", "category")


def relation_insert(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return incoming.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def delete_where(table: DataFrame, test: Column) -> DataFrame:
    return table.filter(~F.coalesce(test, F.lit(False)))


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def delete_orphans(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents that still have a child."""
    return parents.join(children.select(key), key, "left_semi")


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


def cascade(parents: DataFrame, children: DataFrame, key: str, value) -> tuple[DataFrame, DataFrame]:
    gone = F.col(key) == value
    return delete_where(parents, gone), delete_where(children, gone)


def soft_delete(table: DataFrame, test: Column) -> DataFrame:
    return table.withColumn("active", F.when(F.coalesce(test, F.lit(False)), False).otherwise(F.col("active")))


def point_update(table: DataFrame, test: Column, **values) -> DataFrame:
    """Set trimmed values where given and different; ``changed`` tells whether any was."""
    changed = F.lit(False)
    for c, v in values.items():
        if v is not None:
            new = F.lit(v.strip() if isinstance(v, str) else v)
            changed = changed | (test & ~F.col(c).eqNullSafe(new))
    out = table.withColumn("changed", F.coalesce(changed, F.lit(False)))
    for c, v in values.items():
        if v is not None:
            out = out.withColumn(c, F.when(F.col("changed"), F.lit(v.strip() if isinstance(v, str) else v)).otherwise(F.col(c)))
    return out


def create_fares(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """Fares for known lines, the mode looked up; unknown lines give no row (see ``catalog.NotFound``)."""
    return requests.join(lines.select("line_id", "mode_id"), "line_id")


def replace_relations(ordered: DataFrame, parent: str, order: list[Column]) -> DataFrame:
    """A parent's relations made anew: seq from 1, fraction i / (n - 1)."""
    w = Window.partitionBy(parent)
    i = F.row_number().over(w.orderBy(*order))
    return ordered.withColumn("seq", i.cast("long")).withColumn("fraction", F.coalesce((F.col("seq") - 1) / F.nullif(F.count("*").over(w) - 1, F.lit(0)), F.lit(0.0)))
