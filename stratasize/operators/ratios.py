"""Data reduction ratios: lookup, storage models, several workloads, and edits by hand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratasize.functions.tables import DEFAULT_RATIO, LEAST_EDITED_RATIO

#: Flat ratios of storage models (fixed values); other models take the table's.
MODEL_RATIOS = {"powerflex": 2.0, "powervault": 1.0}
EDITABLE = ("workload_category", "workload_subcategory", "drr", "is_ignored")
#: Rows of a dimension that is broadcast without more ado; a larger one joins by a shuffle.
BROADCAST_ROWS = 10_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than so many rows; otherwise Spark chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def attach_ratio(vms: DataFrame, ratios: DataFrame, name: str = "drr") -> DataFrame:
    """vms with the ratio of their workload_category and workload_subcategory, or the default one."""
    table = small(ratios.select(F.col("category").alias("__c"), F.col("subcategory").alias("__s"), F.col("ratio").alias("__ratio")))
    found = vms.join(table, (F.col("workload_category") == F.col("__c")) & (F.col("workload_subcategory") == F.col("__s")), "left")
    return found.withColumn(name, F.coalesce("__ratio", F.lit(DEFAULT_RATIO))).drop("__c", "__s", "__ratio")


def apply_storage_model(vms: DataFrame, model: str, ratios: DataFrame) -> DataFrame:
    """vms with the model's flat ratio, or with the table's."""
    return vms.withColumn("drr", F.lit(MODEL_RATIOS[model])) if model in MODEL_RATIOS else attach_ratio(vms, ratios)


def conservative_ratio(vms: DataFrame, ratios: DataFrame, workloads: str = "workloads", name: str = "conservative_drr") -> DataFrame:
    """vms with the least ratio of their workloads, an array of {category, subcategory}; the default for none.

    The ratio table is bounded, so it becomes a map in the plan and rows stay where they are.
    """
    rows = ratios.select("category", "subcategory", "ratio").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"a ratio table has no more than {BROADCAST_ROWS} rows")
    known = F.create_map(*[x for r in rows for x in (F.lit(f"{r['category']}\x00{r['subcategory']}"), F.lit(r["ratio"]))])
    of = lambda w: F.coalesce(F.try_element_at(known, F.concat_ws("\x00", w["category"], w["subcategory"])), F.lit(DEFAULT_RATIO))
    return vms.withColumn(name, F.coalesce(F.array_min(F.transform(workloads, of)), F.lit(DEFAULT_RATIO)))


def apply_edits(vms: DataFrame, edits: DataFrame, key: str = "row_index", order: str = "edit_no", until: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """vms with the edits' columns (of EDITABLE); edits of unknown rows are ignored, and rows out of scope stay.

    edits is a log: of several edits of a row (its key, in its inventory where `by` names one) the last by `order` counts,
    column by column; a null leaves a column as it is. With `until`, edits after that point are left out, which gives
    the table as it was then. Without the column `order`, or of edits of one number, the greatest value counts. Edits are
    combined before they travel, so a row that was edited very often costs no more than one edit for each task.
    """
    columns = [c for c in EDITABLE if c in edits.columns]
    at = F.col(order) if order in edits.columns else F.lit(0)
    log = edits if until is None else edits.where(at <= until)
    last = log.groupBy(F.col(key).alias("__key"), *by).agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("value")))).alias(f"__{c}") for c in columns])
    met = F.col(key) == F.col("__key")
    for c in by:
        last, met = last.withColumnRenamed(c, f"__by_{c}"), met & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    old = lambda c: F.col(c) if c in vms.columns else F.lit(None)
    return vms.join(last, met, "left").withColumns({c: F.coalesce(F.col(f"__{c}.value"), old(c)) for c in columns}).drop("__key", *[f"__{c}" for c in columns], *[f"__by_{c}" for c in by])


def reassign(vms: DataFrame, ids: DataFrame, category: str, subcategory: str, ratios: DataFrame, key: str = "row_index") -> DataFrame:
    """vms with another workload, and its ratio, for the rows in ids."""
    found = ratios.where((F.col("category") == category) & (F.col("subcategory") == subcategory)).agg(F.max("ratio").alias("r")).first()["r"]
    chosen = _chosen(vms, ids, key)
    new = {"workload_category": F.lit(category), "workload_subcategory": F.lit(subcategory), "drr": F.lit(found if found is not None else DEFAULT_RATIO)}
    return chosen.withColumns({c: F.when(F.col("__chosen"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("__chosen")


def mark_ignored(vms: DataFrame, ids: DataFrame, ignored: bool = True, key: str = "row_index") -> DataFrame:
    old = F.coalesce("is_ignored", F.lit(False)) if "is_ignored" in vms.columns else F.lit(False)
    return _chosen(vms, ids, key).withColumn("is_ignored", F.when(F.col("__chosen"), F.lit(ignored)).otherwise(old)).drop("__chosen")


def _chosen(vms: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    rows = small(ids.select(F.col(key).alias("__key")).distinct())
    return vms.join(rows, F.col(key) == F.col("__key"), "left").withColumn("__chosen", F.col("__key").isNotNull()).drop("__key")


def edited_ratio(value: Column) -> Column:
    """A ratio that was typed in, no less than the least one."""
    return F.greatest(value, F.lit(LEAST_EDITED_RATIO))


def rules_without_ratio(rules: DataFrame, ratios: DataFrame) -> DataFrame:
    """Workloads that rules give and the ratio table lacks."""
    return rules.select("category", "subcategory").distinct().join(ratios, ["category", "subcategory"], "left_anti")


def ratios_without_rule(rules: DataFrame, ratios: DataFrame) -> DataFrame:
    return ratios.select("category", "subcategory").distinct().join(rules, ["category", "subcategory"], "left_anti")
