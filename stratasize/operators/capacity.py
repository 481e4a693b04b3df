"""Capacity of machines from their disks, partitions and performance samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratasize.functions import expressions as X
from stratasize.operators.ratios import small
from stratasize.sources.columns import MEASURED
from stratasize.sources.sinks import stored


def joined(left: DataFrame, right: DataFrame, on: dict[str, Column], by: Sequence[str] = (), how: str = "left") -> DataFrame:
    """left with right by right's columns (keys of `on`) and the columns that name an inventory, which both sides have;
    of those only left's stay."""
    right = right.withColumnsRenamed({c: f"__by_{c}" for c in by})
    met = F.lit(True)
    for name, value in on.items():
        met = met & (value == F.col(name))
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return left.join(right, met, how).drop(*[f"__by_{c}" for c in by])


def disk_totals(disks: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Sums of each machine's disks by `key` (mob_id or vm_name) in its inventory (columns `by`), with the smallest other
    name; blank keys go."""
    other = [c for c in ("mob_id", "vm_name") if c != key and c in disks.columns]
    rows = disks.withColumn(key, X.stripped(X.text_or_empty(F.col(key)))).where(F.col(key) != "")
    used = X.number(F.col("used_mib")) if "used_mib" in disks.columns else F.lit(0.0)
    return rows.groupBy(*by, key).agg(F.sum(X.number(F.col("capacity_mib"))).alias("capacity_mib"), F.sum(used).alias("used_mib"), *[F.min(c).alias(c) for c in other])


def override_by_disks(vms: DataFrame, disks: DataFrame | None, by: Sequence[str] = ()) -> DataFrame:
    """vms with provisioned and used space from their disks where they have any.

    The key is the MOB id in an inventory (columns `by`) in which every disk has one, else the name; disks are summed by
    the key that joins, so no row of vms repeats, and ids that several inventories use don't meet. A machine without
    disks keeps its values; None is an absent sheet.
    """
    if disks is None or "capacity_mib" not in disks.columns:
        return vms
    ids, names = ({"mob_id", "vm_name"} & set(t.columns) for t in (vms, disks))
    both = ids & names
    if not both:
        return vms
    own = lambda c: X.stripped(X.text_or_empty(F.col(c)))
    key = F.concat(F.lit("name:"), own("vm_name")) if "vm_name" in both else None
    by_id = F.concat(F.lit("id:"), own("mob_id")) if "mob_id" in both else None
    blank = ["id:", "name:"]
    if key is not None and by_id is not None:
        kinds = small(disks.groupBy(*by).agg(F.coalesce(F.min(own("mob_id") != ""), F.lit(False)).alias("__by_id")))
        vms, disks = (joined(t, kinds, {}, by) for t in (vms, disks))
        key = F.when(F.col("__by_id"), by_id).otherwise(key)
    elif key is None:
        key = by_id
    used = X.number(F.col("used_mib")) if "used_mib" in disks.columns else F.lit(0.0)
    sums = disks.withColumn("__disk", key).where(~F.col("__disk").isin(blank)).groupBy(*by, "__disk").agg(F.sum(X.number(F.col("capacity_mib"))).alias("__capacity"), F.sum(used).alias("__used"))
    found = joined(vms.withColumn("__key", key), sums, {"__disk": F.col("__key")}, by)
    out = {"provisioned_mib": F.coalesce("__capacity", "provisioned_mib")}
    if "used_mib" in disks.columns:
        out["in_use_mib"] = F.coalesce("__used", "in_use_mib")
    return found.withColumns(out).drop("__key", "__disk", "__capacity", "__used", "__by_id")


def attach_performance(vms: DataFrame, samples: DataFrame | None, by: Sequence[str] = ()) -> DataFrame:
    """vms with measured columns by trimmed name in their inventory (columns `by`); samples of one name come together
    first (the highest peak, the mean of averages), so no machine repeats. KB/s become MB/s, and IOPS of 8 KB."""
    if samples is None:
        return vms
    fold = lambda c: F.avg(c) if c.startswith("avg") else F.max(c)
    names = [c for c in samples.columns if c != "vm_name" and c not in by]
    rows = samples.select(*by, X.stripped(X.text_or_empty(F.col("vm_name"))).alias("__key"), *[X.number(F.col(c), None).alias(c) for c in names]).where(F.col("__key") != "")
    per = rows.groupBy(*by, "__key").agg(*[fold(c).alias(f"__{c}") for c in names])
    found = joined(vms, per, {"__key": X.stripped(F.col("vm_name"))}, by)
    out = {c: F.coalesce(f"__{c}", c) if c in vms.columns else F.col(f"__{c}") for c in names if c in MEASURED}
    for kind in ("peak", "avg"):
        if f"{kind}_throughput_kbs" in names:
            out[f"{kind}_throughput_mbs"] = X.mb_per_second(F.col(f"__{kind}_throughput_kbs"))
    if "peak_throughput_kbs" in names:
        out["iops_8k_equivalent"] = X.iops_of_8k(F.col("__peak_throughput_kbs"))
    return found.withColumns(out).drop("__key", *[f"__{c}" for c in names])


def totals_by(sheet: DataFrame, key: str, values: list[str], prefix: str, by: Sequence[str] = ()) -> DataFrame:
    """Sums by a stripped, non-blank key, named by prefix; a sum shows that rows are there even if it is 0."""
    rows = sheet.withColumn("__k", X.stripped(X.text_or_empty(F.col(key)))).where(F.col("__k") != "")
    return rows.groupBy(*by, F.col("__k").alias(f"{prefix}_key")).agg(*[F.sum(X.number(F.col(v))).alias(f"{prefix}_{v}") for v in values])


def look_up_twice(vms: DataFrame, sheet: DataFrame | None, values: list[str], prefix: str, by: Sequence[str] = ()) -> DataFrame:
    """vms with a sheet's sums by UUID, or by name where the UUID is not in it, in their inventory (columns `by`):
    prefix_value, and prefix_found.

    Two left joins on aggregated keys; vms has vm_uuid (may be blank) and vm_name. A sheet with both keys is summed by
    both at once and written, so that its rows are read and joined once and only the sums meet each key.
    """
    if sheet is None:
        return vms.withColumns({f"{prefix}_{v}": F.lit(0.0) for v in values} | {f"{prefix}_found": F.lit(False)})
    out, picked, both = vms, [], ("vm_uuid", "vm_name")
    if all(k in t.columns for k in both for t in (vms, sheet)):
        sheet = stored(sheet.groupBy(*by, *both).agg(*[F.sum(X.number(F.col(v))).alias(v) for v in values]), f"{prefix}-sums")
    for nth, key in enumerate(("vm_uuid", "vm_name")):
        if key in sheet.columns and key in vms.columns:
            own = f"__{prefix}{nth}"
            out = joined(out, totals_by(sheet, key, values, own, by), {f"{own}_key": X.stripped(X.text_or_empty(F.col(key)))}, by)
            picked.append(own)
    found = [F.col(f"{p}_key").isNotNull() for p in picked]
    choose = lambda v: F.coalesce(*[F.when(f, F.col(f"{p}_{v}")) for f, p in zip(found, picked, strict=True)], F.lit(0.0))
    any_found = F.lit(False)
    for f in found:
        any_found = any_found | f
    out = out.withColumns({f"{prefix}_{v}": choose(v) for v in values} | {f"{prefix}_found": any_found})
    return out.drop(*[f"{p}_{x}" for p in picked for x in (*values, "key")])


def guest_capacity(vms: DataFrame, partitions: DataFrame | None, disks: DataFrame | None, by: Sequence[str] = ()) -> DataFrame:
    """vms (with vm_uuid, total_disk_capacity_mib where known) on the guest's view of capacity; ids and names count within
    an inventory (columns `by`, which all tables have).

    Provisioned: the larger of all partitions and the logical disks (total disk capacity, or the disks' sum where that
    is 0), else as exported. Used: what partitions consume if there is any, else as exported; never above provisioned.
    Adds raw_provisioned_mib and capacity_fallback (nothing but the exported value was known).
    """
    rows = look_up_twice(look_up_twice(vms, partitions, ["capacity_mib", "consumed_mib"], "part", by), disks, ["capacity_mib"], "disk", by)
    total = X.number(F.col("total_disk_capacity_mib")) if "total_disk_capacity_mib" in vms.columns else F.lit(0.0)
    logical = F.when(total > 0, total).otherwise(F.col("disk_capacity_mib"))
    known = F.greatest("part_capacity_mib", logical)
    rows = rows.withColumns({"raw_provisioned_mib": F.col("provisioned_mib"), "capacity_fallback": known <= 0, "__known": known})
    rows = rows.withColumn("provisioned_mib", F.when(F.col("__known") > 0, F.col("__known")).otherwise(F.col("provisioned_mib")))
    used = F.when(F.col("part_found"), F.col("part_consumed_mib")).otherwise(F.col("in_use_mib"))
    rows = rows.withColumn("in_use_mib", F.least(used, F.col("provisioned_mib")))
    return rows.drop("__known", "part_capacity_mib", "part_consumed_mib", "part_found", "disk_capacity_mib", "disk_found")


def on_vsan(vms: DataFrame, datastores: DataFrame | None, path: str = "vm_path", by: Sequence[str] = ()) -> DataFrame:
    """The rows of vms whose home datastore, in brackets in their path, has a type with `vsan` in it, in their inventory."""
    if datastores is None or path not in vms.columns:
        return vms.limit(0)
    kinds = datastores.where(F.lower("type").contains("vsan")).select(*by, F.col("name").alias("__home")).distinct()
    return joined(vms, kinds, {"__home": X.home_datastore(F.col(path))}, by, "left_semi")


def capacity_report(guest: DataFrame, datastores: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """A row for each inventory (columns `by`; one row without) over guest_capacity(): machines, fallbacks, machines on
    vSAN, sums before and after, and whether they differ."""
    sums = guest.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_vms"), F.count_if("capacity_fallback").alias("fallback_count"), _sum("raw_provisioned_mib").alias("pre_provisioned_mib"),
        _sum("provisioned_mib").alias("post_provisioned_mib"), _sum("in_use_mib").alias("post_in_use_mib"),
    )
    vsan = on_vsan(guest, datastores, by=by).groupBy(*by).agg(F.count(F.lit(1)).alias("__vsan"))
    found = joined(sums, vsan, {}, by).withColumn("vsan_vm_count", F.coalesce("__vsan", F.lit(0))).drop("__vsan")
    return found.withColumn("changed", F.abs(F.col("pre_provisioned_mib") - F.col("post_provisioned_mib")) > 0.5)


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))
