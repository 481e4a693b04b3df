"""Required capacity, and totals by workload, over all machines and for review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratasize.functions import expressions as X
from stratasize.functions.tables import DEFAULT_RATIO, UNKNOWN
from stratasize.operators.filters import without_ignored


def _sum(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def _or_zero(df: DataFrame, c: str) -> Column:
    return X.number_in(df, c) if c in df.columns else F.lit(0.0)


def size_machines(vms: DataFrame, exclude_ignored: bool = True) -> DataFrame:
    """vms with a usable drr (5.0 where it is not positive), provisioned and measured numbers without nulls, and
    required_mib = provisioned / drr."""
    rows = without_ignored(vms, exclude_ignored)
    ratio = _or_zero(rows, "drr") if "drr" in rows.columns else F.lit(DEFAULT_RATIO)
    numbers = ("provisioned_mib", "in_use_mib", "peak_iops", "avg_iops", "peak_throughput_mbs", "iops_8k_equivalent", "memory_mib", "num_cpus")
    category = F.coalesce("workload_category", F.lit(UNKNOWN)) if "workload_category" in rows.columns else F.lit(UNKNOWN)
    rows = rows.withColumns({c: _or_zero(rows, c) for c in numbers} | {"drr": F.when(ratio > 0, ratio).otherwise(F.lit(DEFAULT_RATIO)), "workload_category": category})
    return rows.withColumn("required_mib", F.col("provisioned_mib") / F.col("drr"))



def _measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("vm_count")] + [_sum(c).alias(f"total_{c}") for c in ("provisioned_mib", "in_use_mib", "required_mib")]


def workload_groups(sized: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Machines and sums by (workload_category, drr): one category with two ratios gives two rows. `by`: further keys,
    such as an inventory. Ordered by all keys; combined before the shuffle, so a hot category is no burden."""
    return sized.groupBy(*by, F.col("workload_category").alias("category"), "drr").agg(*_measures()).orderBy(*by, "category", "drr")


def category_rollup(sized: DataFrame) -> DataFrame:
    """workload_groups() by category with the effective ratio, largest first."""
    groups = workload_groups(sized).groupBy("category").agg(*[F.sum(c).alias(c) for c in ("vm_count", "total_provisioned_mib", "total_in_use_mib", "total_required_mib")])
    return groups.withColumn("effective_drr", F.coalesce(F.try_divide("total_provisioned_mib", "total_required_mib"), F.lit(0.0))).orderBy(F.desc("total_provisioned_mib"), "category")


def breakdown(sized: DataFrame) -> DataFrame:
    """workload_groups() in order and a last row TOTAL with the weighted ratio, in one pass."""
    sets = sized.groupingSets([[F.col("workload_category"), F.col("drr")], []], F.col("workload_category"), F.col("drr")).agg(*_measures(), F.grouping("workload_category").alias("is_total"))
    ratio = F.when(F.col("is_total") == 1, F.coalesce(F.try_divide("total_provisioned_mib", "total_required_mib"), F.lit(0.0))).otherwise(F.col("drr"))
    category = F.when(F.col("is_total") == 1, F.lit("TOTAL")).otherwise(F.col("workload_category"))
    return sets.select(category.alias("category"), ratio.alias("drr"), "vm_count", "total_provisioned_mib", "total_in_use_mib", "total_required_mib", F.col("is_total").cast("int").alias("is_total")).orderBy("is_total", "category", "drr")


def grand_summary(sized: DataFrame) -> DataFrame:
    """One row over all machines; zeros and empty names for none. Largest and hottest machine: the first by row_index
    on a tie; the hottest is empty without measurements."""
    order = (-F.col("row_index")).alias("minus") if "row_index" in sized.columns else F.xxhash64("vm_name").alias("minus")
    top = lambda c: F.max(F.struct(c, order, "vm_name"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    one = sized.agg(
        F.count(F.lit(1)).alias("total_vms"), _sum("provisioned_mib").alias("total_provisioned_mib"), _sum("in_use_mib").alias("total_in_use_mib"), _sum("required_mib").alias("total_required_mib"),
        F.coalesce(F.sum(F.col("num_cpus").cast("long")), F.lit(0)).alias("total_cpus"), _sum("memory_mib").alias("total_memory_mib"), top("provisioned_mib").alias("largest"), top("peak_iops").alias("hottest"),
        _sum("avg_iops").alias("total_avg_iops"), F.coalesce(F.max("peak_throughput_mbs"), F.lit(0.0)).alias("peak_throughput_mbs"), _sum("iops_8k_equivalent").alias("total_iops_8k_equivalent"),
        F.coalesce(F.bool_or(F.col("peak_iops") > 0), F.lit(False)).alias("has_performance_data"),
    )
    return one.select(
        "total_vms", "total_provisioned_mib", "total_in_use_mib", "total_required_mib", share("total_provisioned_mib", "total_required_mib").alias("weighted_avg_drr"),
        share("total_provisioned_mib", "total_vms").alias("avg_vm_size_mib"), share("total_cpus", "total_vms").alias("avg_vm_cpus"), share("total_memory_mib", "total_vms").alias("avg_vm_memory_mib"),
        "total_cpus", "total_memory_mib", F.coalesce("largest.vm_name", F.lit("")).alias("largest_vm_name"), F.coalesce("largest.provisioned_mib", F.lit(0.0)).alias("largest_vm_provisioned_mib"), "total_avg_iops",
        F.when(F.col("has_performance_data"), F.col("hottest.peak_iops")).otherwise(0.0).alias("max_vm_peak_iops"), F.when(F.col("has_performance_data"), F.col("hottest.vm_name")).otherwise("").alias("max_vm_peak_iops_name"),
        "peak_throughput_mbs", "total_iops_8k_equivalent", "has_performance_data",
    )


def review_cards(vms: DataFrame) -> DataFrame:
    """One row for the review: machines that aren't ignored, their provisioned space, the plain mean of their ratios,
    the space at each one's ratio, and how many are ignored."""
    ignored = F.coalesce("is_ignored", F.lit(False)) if "is_ignored" in vms.columns else F.lit(False)
    rows = vms.select((~ignored).alias("on"), X.number(F.col("provisioned_mib")).alias("p"), X.number(F.col("drr"), DEFAULT_RATIO).alias("d"))
    return rows.agg(
        F.count_if("on").alias("vm_count"), _sum(F.when(F.col("on"), F.col("p"))).alias("total_provisioned_mib"), F.coalesce(F.avg(F.when(F.col("on"), F.col("d"))), F.lit(0.0)).alias("mean_drr"),
        _sum(F.when(F.col("on") & (F.col("d") > 0), F.try_divide("p", "d"))).alias("effective_mib"), F.count_if(~F.col("on")).alias("ignored_count"),
    )
