"""Health checks over an inventory, as a table of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratasize.functions import expressions as X
from stratasize.sources.sinks import stored

# Thresholds.
POWERED_OFF_SHARE, UNKNOWN_SHARE, LARGE_MIB, IOPS_BUDGET, OLD_HARDWARE, VERY_OLD_HARDWARE, SMALL_CLUSTER, SAMPLES = 0.30, 0.25, 1024.0 * 1024, 100_000.0, 17, 14, 3, 5

# Checks in the order in which they run, with severities.
CHECKS = {
    "data_quality.missing_os": "warning",
    "data_quality.zero_provisioned": "warning",
    "data_quality.missing_cpu": "info",
    "data_quality.missing_ram": "info",
    "data_quality.high_powered_off_ratio": "info",
    "sizing_risk.high_unknown_ratio": "warning",
    "sizing_risk.large_unknown_vms": "warning",
    "sizing_risk.iops_budget_exceeded": "warning",
    "best_practice.no_cluster": "warning",
    "best_practice.very_old_hw_version": "critical",
    "best_practice.old_hw_version": "warning",
    "best_practice.small_cluster_ha": "warning",
    "best_practice.tools_not_installed": "critical",
    "best_practice.tools_not_running": "warning",
}
REMEDIES = {
    "data_quality.missing_os": "Run the guest tools on these machines and export again: the tools report the OS.",
    "data_quality.zero_provisioned": "Check these machines' disks in the hypervisor; a machine without disks needs no storage.",
    "data_quality.missing_cpu": "Export again with the CPU columns.",
    "data_quality.missing_ram": "Export again with the memory columns.",
    "data_quality.high_powered_off_ratio": "Ask whether these machines are retired, or the export was made during maintenance.",
    "sizing_risk.high_unknown_ratio": "Classify these machines by hand, or add rules for this site's names.",
    "sizing_risk.large_unknown_vms": "Classify these large machines first: their ratio moves the total most.",
    "sizing_risk.iops_budget_exceeded": "Give these machines datastores of their own, or spread their disks.",
    "best_practice.no_cluster": "Move these machines into a cluster.",
    "best_practice.very_old_hw_version": "Upgrade this cluster's hosts and machine versions at once.",
    "best_practice.old_hw_version": "Plan an upgrade of this cluster's hosts and machine versions.",
    "best_practice.small_cluster_ha": "Add a host, so that one failure leaves enough capacity.",
    "best_practice.tools_not_installed": "Install the guest tools before any migration.",
    "best_practice.tools_not_running": "Start the guest tools.",
}
NO_CLUSTER = "(No Cluster)"
SEVERITIES = ("critical", "warning", "info")


def _row_checks() -> dict[str, Column]:
    text = lambda c: X.stripped(X.text_or_empty(F.col(c)))
    unknown = F.coalesce("workload_category", F.lit("")).startswith("Unknown")
    return {
        "data_quality.missing_os": text("os_name") == "",
        "data_quality.zero_provisioned": X.number(F.col("provisioned_mib")) == 0,
        "data_quality.missing_cpu": X.number(F.col("num_cpus")) == 0,
        "data_quality.missing_ram": X.number(F.col("memory_mib")) == 0,
        "sizing_risk.high_unknown_ratio": unknown,
        "sizing_risk.large_unknown_vms": unknown & (X.number(F.col("provisioned_mib")) >= LARGE_MIB),
        "sizing_risk.iops_budget_exceeded": X.number(F.col("peak_iops")) > IOPS_BUDGET,
        "best_practice.no_cluster": text("cluster") == "",
        "best_practice.tools_not_installed": F.coalesce("tools_status", F.lit("")) == "toolsNotInstalled",
        "best_practice.tools_not_running": F.coalesce("tools_status", F.lit("")) == "toolsNotRunning",
    }


def run_health_checks(vms: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """A row for each finding: check_id, severity, cluster, affected_count, affected_vms (the first five names by
    row_index), remediation, check_order, checked_vms; and group_cols, for a fleet of inventories in one job.

    Row checks are one pass: each row gives the ids that it meets, and counts combine before the shuffle. Samples are
    the rows that rank below six in a check; only those are gathered. No rows: no findings. What the checks need of each
    row, and what they find, are written to the shared folder, so vms is evaluated once.
    """
    groups = list(group_cols)
    on = F.coalesce("is_powered_on", F.lit(False))
    active = on & ~F.coalesce("is_template", F.lit(False))
    label = X.stripped(X.text_or_empty(F.col("cluster")))
    hw = X.number(F.col("hw_version"))
    checks = _row_checks()
    met = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    cluster = F.when(label == "", F.lit(NO_CLUSTER)).otherwise(label)
    row = vms.select(
        *groups, "row_index", "vm_name", active.alias("active"), (~on).alias("off"), cluster.alias("cluster"),
        ((hw > 0) & (hw < VERY_OLD_HARDWARE)).alias("very_old"), ((hw >= VERY_OLD_HARDWARE) & (hw < OLD_HARDWARE)).alias("old"), met.alias("met"),
    )
    row = stored(row, "health-rows")  # read for the totals, the checks and the clusters
    totals = row.groupBy(*groups).agg(F.count(F.lit(1)).alias("all_vms"), F.count_if("active").alias("checked_vms"), F.count_if("off").alias("off_vms"))
    live = row.where("active")
    by_row = live.withColumn("check_id", F.explode("met")).select(*groups, "check_id", F.lit("").alias("cluster"), "row_index", "vm_name")
    per_cluster = live.groupBy(*groups, "cluster").agg(F.count_if("very_old").alias("n_very"), F.count_if("old").alias("n_old"), F.count(F.lit(1)).alias("n"))
    found = F.filter(
        F.array(
            F.when(F.col("n_very") > 0, F.lit("best_practice.very_old_hw_version")),
            F.when((F.col("n_very") == 0) & (F.col("n_old") > 0), F.lit("best_practice.old_hw_version")),
            F.when((F.col("cluster") != NO_CLUSTER) & (F.col("n") < SMALL_CLUSTER), F.lit("best_practice.small_cluster_ha")),
        ),
        lambda x: x.isNotNull(),
    )
    clusters = per_cluster.select(*groups, "cluster", F.explode(found).alias("check_id"))
    rows = live.select(*groups, "cluster", "row_index", "vm_name", "very_old", "old").join(clusters, [*groups, "cluster"])
    rows = rows.where((F.col("check_id") == "best_practice.small_cluster_ha") | F.when(F.col("check_id") == "best_practice.old_hw_version", F.col("old")).otherwise(F.col("very_old")))
    hits = stored(by_row.unionByName(rows.select(*groups, "check_id", "cluster", "row_index", "vm_name")), "health-hits")
    counted = _first_names(hits, [*groups, "check_id", "cluster"])
    counted = counted.join(totals, groups) if groups else counted.crossJoin(F.broadcast(totals))  # one row
    counted = counted.where((F.col("check_id") != "sizing_risk.high_unknown_ratio") | (F.col("affected_count") > UNKNOWN_SHARE * F.col("checked_vms")))
    off = totals.where(F.col("off_vms") > POWERED_OFF_SHARE * F.col("all_vms")).select(
        *groups, F.lit("data_quality.high_powered_off_ratio").alias("check_id"), F.lit("").alias("cluster"), F.col("off_vms").alias("affected_count"), F.array().cast("array<string>").alias("affected_vms"), "checked_vms"
    )
    out = counted.select(*groups, "check_id", "cluster", "affected_count", "affected_vms", "checked_vms").unionByName(off)
    known = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("check_id")]
    return out.withColumns({"severity": known(CHECKS), "remediation": known(REMEDIES), "check_order": known({k: i for i, k in enumerate(CHECKS)})})


def _first_names(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each key, combined before the shuffle, and the names of its first rows: those that rank no more than
    five, first in one of 64 parts of a key (so a check that every row meets is spread), then in the key."""
    counts = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("affected_count"))
    part = F.pmod(F.xxhash64("row_index"), F.lit(64))
    rank = lambda *by: F.row_number().over(W.partitionBy(*keys, *by).orderBy("row_index", "vm_name"))
    some = hits.withColumn("__part", part).withColumn("__n", rank("__part")).where(F.col("__n") <= SAMPLES)
    some = some.withColumn("__n", rank()).where(F.col("__n") <= SAMPLES)
    names = some.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__n", "vm_name"))).alias("s"))
    return counts.join(names, keys).withColumn("affected_vms", F.transform("s", lambda x: x["vm_name"])).drop("s")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").count()


def by_section(findings: DataFrame) -> DataFrame:
    return findings.withColumn("section", F.substring_index("check_id", ".", 1))


def report_order() -> list[Column]:
    rank = F.when(F.col("severity") == SEVERITIES[0], 0).when(F.col("severity") == SEVERITIES[1], 1).otherwise(2)
    return [rank, F.col("check_id"), F.col("cluster")]
