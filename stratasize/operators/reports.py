"""Report datasets: tables behind charts, summaries and detail sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratasize.functions import expressions as X
from stratasize.operators.health import by_section, report_order

PROVISIONED, REQUIRED, BEFORE, AFTER = "Provisioned", "Required", "Before", "After"


def _node_names(groups: DataFrame) -> DataFrame:
    """groups with node: the category, with its ratio where it comes with several."""
    many = F.count(F.lit(1)).over(W.partitionBy("category")) > 1
    return groups.withColumn("node", F.when(many, F.format_string("%s (%.1fx)", "category", "drr")).otherwise(F.col("category")))


def flow_edges(groups: DataFrame) -> DataFrame:
    """(source, target, gib): provisioned space to each category, and from it to required space. With fewer than two
    groups a table of before and after instead. groups: workload_groups(), as many rows as workloads."""
    g = _node_names(groups).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy()))
    edge = lambda a, b, mib: F.struct(a.alias("source"), b.alias("target"), F.round(X.gib(F.col(mib)), 1).alias("gib"))
    several = F.array(edge(F.lit(PROVISIONED), F.col("node"), "total_provisioned_mib"), edge(F.col("node"), F.lit(REQUIRED), "total_required_mib"))
    single = F.array(edge(F.lit(BEFORE), F.col("node"), "total_provisioned_mib"), edge(F.lit(AFTER), F.col("node"), "total_required_mib"))
    return g.select(F.explode(F.when(F.col("__n") < 2, single).otherwise(several)).alias("e")).select("e.*")


def shares(groups: DataFrame) -> DataFrame:
    """(node, gib, share) of provisioned space."""
    whole = F.sum("total_provisioned_mib").over(W.partitionBy())
    return _node_names(groups).select("node", F.round(X.gib(F.col("total_provisioned_mib")), 1).alias("gib"), F.coalesce(F.try_divide("total_provisioned_mib", whole), F.lit(0.0)).alias("share"))


def ratios_by_group(groups: DataFrame) -> DataFrame:
    return _node_names(groups).select("node", "drr")


def provisioned_and_required(groups: DataFrame) -> DataFrame:
    gib = lambda c: F.round(X.gib(F.col(c)), 1)
    return _node_names(groups).select("node", gib("total_provisioned_mib").alias("provisioned_gib"), gib("total_required_mib").alias("required_gib"))


def summary_rows(summary: DataFrame) -> DataFrame:
    """(position, metric, value) of a grand_summary(); rows of performance only if there was any."""
    gib = lambda c: X.gib(F.col(c))
    text = lambda c: c.cast("string")
    hottest = F.concat("max_vm_peak_iops_name", F.lit(" ("), F.format_number("max_vm_peak_iops", 0), F.lit(")"))
    always = {
        "total_vms": F.col("total_vms"), "total_cpus": F.col("total_cpus"), "total_memory_gib": gib("total_memory_mib"), "total_provisioned_gib": gib("total_provisioned_mib"), "total_in_use_gib": gib("total_in_use_mib"),
        "required_capacity_gib": gib("total_required_mib"), "avg_cpus": F.col("avg_vm_cpus"), "avg_memory_gib": gib("avg_vm_memory_mib"), "avg_storage_gib": gib("avg_vm_size_mib"), "weighted_drr": F.col("weighted_avg_drr"),
        "largest_vm": X.safe_cell(F.col("largest_vm_name")),
    }
    measured = {"total_avg_iops": F.col("total_avg_iops"), "hottest_vm": X.safe_cell(hottest), "peak_throughput_mbs": F.col("peak_throughput_mbs"), "iops_8k": F.col("total_iops_8k_equivalent")}
    rows = [F.struct(F.lit(i).alias("position"), F.lit(k).alias("metric"), text(v).alias("value"), F.lit(k in measured).alias("measured")) for i, (k, v) in enumerate((always | measured).items())]
    out = summary.select("has_performance_data", F.explode(F.array(*rows)).alias("r"))
    return out.where(~F.col("r.measured") | F.col("has_performance_data")).select("r.position", "r.metric", "r.value")


def machine_detail(sized: DataFrame) -> DataFrame:
    """Machines with space in GiB and texts safe for a spreadsheet."""
    return sized.select(
        "row_index", X.safe_cell(F.col("vm_name")).alias("vm_name"), X.safe_cell(F.col("os_name")).alias("os_name"), X.safe_cell(F.col("workload_category")).alias("workload_category"), "drr",
        *[X.gib(F.col(f"{c}_mib")).alias(f"{c}_gib") for c in ("provisioned", "in_use", "required")],
    )


def findings_table(findings: DataFrame) -> DataFrame:
    """Findings by severity, with their section and share of the machines checked."""
    share = F.round(F.col("affected_count") * 100 / F.greatest("checked_vms", F.lit(1)), 1)
    return by_section(findings).select("severity", "section", "check_id", "cluster", "affected_count", share.alias("pct"), "remediation").orderBy(*report_order())


def report_tables(sized: DataFrame, summary: DataFrame, groups: DataFrame, findings: DataFrame, stores: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a report by name; write each with sources.sinks.write_tables()."""
    out = {"summary": summary_rows(summary), "breakdown": groups, "machines": machine_detail(sized), "findings": findings_table(findings)}
    return out | ({"layout": stores.withColumn("workloads", F.array_join("workloads", ", "))} if stores is not None else {})
