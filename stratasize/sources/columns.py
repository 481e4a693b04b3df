"""Header spellings, and the canonical inventory table that exports are mapped to."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratasize.functions import expressions as X

# The canonical columns in their order. Numbers without data are 0, texts "", measured columns null.
# row_index follows them: operators.filters numbers rows once templates are gone.
CANONICAL = T.StructType(
    [
        T.StructField("vm_name", T.StringType()),
        T.StructField("os_name", T.StringType()),
        T.StructField("num_cpus", T.IntegerType()),
        T.StructField("memory_mib", T.DoubleType()),
        T.StructField("provisioned_mib", T.DoubleType()),
        T.StructField("in_use_mib", T.DoubleType()),
        T.StructField("datacenter", T.StringType()),
        T.StructField("cluster", T.StringType()),
        T.StructField("is_template", T.BooleanType()),
        T.StructField("is_powered_on", T.BooleanType()),
        T.StructField("source_format", T.StringType()),
        T.StructField("vm_description", T.StringType()),
        T.StructField("vm_folder", T.StringType()),
        T.StructField("peak_iops", T.DoubleType()),
        T.StructField("avg_iops", T.DoubleType()),
        T.StructField("peak_throughput_mbs", T.DoubleType()),
        T.StructField("avg_throughput_mbs", T.DoubleType()),
        T.StructField("peak_latency_ms", T.DoubleType()),
        T.StructField("avg_read_latency_ms", T.DoubleType()),
        T.StructField("avg_write_latency_ms", T.DoubleType()),
        T.StructField("iops_8k_equivalent", T.DoubleType()),
        T.StructField("hw_version", T.IntegerType()),
        T.StructField("tools_status", T.StringType()),
    ]
)
MEASURED = [f.name for f in CANONICAL if f.name.endswith(("_iops", "_mbs", "_ms", "_equivalent"))]

# For each canonical column, the spellings in exports; the first that is there wins.
RVTOOLS = {
    "vm_name": ["VM", "VM Name"],
    "powerstate": ["Powerstate", "Power State"],
    "is_template": ["Template"],
    "os_name": ["OS according to the VMware Tools", "OS according to the configuration file"],
    "num_cpus": ["CPUs", "Num CPUs", "vCPUs"],
    "memory_mib": ["Memory", "Memory MB", "Memory MiB"],
    "provisioned_mib": ["Provisioned MB", "Provisioned MiB"],
    "in_use_mib": ["In Use MB", "In Use MiB"],
    "total_disk_capacity_mib": ["Total disk capacity MiB", "Total disk capacity MB"],
    "datacenter": ["Datacenter"],
    "cluster": ["Cluster"],
    "vm_description": ["Annotation", "Notes"],
    "vm_folder": ["Folder", "VM Folder", "Path"],
    "hw_version": ["HW version", "Hardware version", "HW Version"],
    "tools_status": ["Tools Status", "VMware Tools Status"],
    "vm_uuid": ["VM UUID"],
    "vm_path": ["Path"],
}
LIVEOPTICS = {
    "vm_name": ["VM Name"],
    "os_name": ["VM OS"],
    "num_cpus": ["Virtual CPU", "vCPU", "CPUs"],
    "memory_mib": ["Provisioned Memory (MiB)", "Memory (MiB)", "Memory MB"],
    "provisioned_mib": ["Virtual Disk Size (MiB)"],
    "in_use_mib": ["Guest VM Disk Used (MiB)"],
    "is_template": ["Template"],
    "powerstate": ["Power State"],
    "datacenter": ["Datacenter"],
    "cluster": ["Cluster"],
    "vm_description": ["Description", "Notes", "Annotation"],
    "vm_folder": ["Folder", "Path", "VM Folder"],
    "mob_id": ["MOB ID"],
}
PERFORMANCE = {
    "vm_name": ["VM Name"],
    "peak_iops": ["Peak IOPS", "Peak Total IOPS"],
    "avg_iops": ["Average IOPS", "Average Total IOPS"],
    "peak_throughput_kbs": ["Max KB/sec", "Peak KB/sec", "Max Total KB/sec"],
    "avg_throughput_kbs": ["Average KB/sec", "Average Total KB/sec"],
    "peak_latency_ms": ["Max Latency(ms)", "Peak Latency(ms)", "Max Latency (ms)"],
    "avg_read_latency_ms": ["Average Read Latency(ms)", "Average Read Latency (ms)"],
    "avg_write_latency_ms": ["Average Write Latency(ms)", "Average Write Latency (ms)"],
}
VM_DISKS = {"mob_id": ["MOB ID"], "vm_name": ["VM Name"], "instance_uuid": ["InstanceUUID"], "capacity_mib": ["Capacity (MiB)"], "used_mib": ["Used (MiB)"]}
VDISK = {"vm_uuid": ["VM UUID"], "vm_name": ["VM"], "capacity_mib": ["Capacity MiB", "Capacity MB"]}
VPARTITION = VDISK | {"consumed_mib": ["Consumed MiB", "Consumed MB"]}
VDATASTORE = {"name": ["Name"], "type": ["Type"]}
REQUIRED = ("vm_name", "os_name", "provisioned_mib", "in_use_mib")


class MissingColumns(ValueError):
    """An export lacks columns that it must have."""


def trimmed(df: DataFrame) -> DataFrame:
    """df with headers less white space and a byte order mark at their ends."""
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def resolve(columns: Collection[str], aliases: Mapping[str, list[str]], required: Collection[str] = ()) -> dict[str, str]:
    """The spelling in columns of each canonical column that is there. No job runs.

    Raises MissingColumns with the required ones that are not, and the first 15 columns.
    """
    found = {name: next(a for a in spellings if a in columns) for name, spellings in aliases.items() if any(a in columns for a in spellings)}
    missing = sorted(set(required) - set(found))
    if missing:
        raise MissingColumns(f"missing columns: {missing}; there are (first 15): {list(columns)[:15]}")
    return found


def named(df: DataFrame, aliases: Mapping[str, list[str]], required: Collection[str] = (), row_wise: bool = False, carry: Collection[str] = ()) -> DataFrame:
    """df with canonical names for the columns that aliases know; others go, but for those in `carry`, which say where a
    row is from. The first spelling that the table has wins; in a table of many files (with source_file) the first that a
    row's file has, that is, in which the cell isn't null; with row_wise the first that isn't blank in a row."""
    df = trimmed(df)
    found = resolve(df.columns, aliases, required)
    cols = [F.col(f"`{c}`") for c in carry if c in df.columns]
    for name, spelling in found.items():
        own = [F.col(f"`{a}`").cast("string") for a in aliases[name] if a in df.columns]
        if row_wise:
            own = [F.coalesce(*[F.when(X.stripped(c) != "", c) for c in own], own[0])]
        elif "source_file" in df.columns and len(own) > 1:
            own = [F.coalesce(*own)]
        else:
            own = [F.col(f"`{spelling}`")]
        cols.append(own[0].alias(name))
    return df.select(*cols)


def canonical(df: DataFrame, aliases: Mapping[str, list[str]], source_format: str, keep: Collection[str] = (), row_wise: bool = False, carry: Collection[str] = ()) -> DataFrame:
    """An export's main table as the canonical table, one projection; `keep` names further known columns to leave in,
    `carry` columns to leave as they are.

    Blanks: texts "", numbers 0, template false; powered on is true without the column and false for a blank cell.
    Measured columns are null where nothing was measured.
    """
    rows = named(df, aliases, REQUIRED, row_wise, carry)
    col = lambda name: F.col(name) if name in rows.columns else F.lit(None)

    def one(field: T.StructField) -> Column:
        name = field.name
        if name == "source_format":
            return F.lit(source_format)
        if name == "is_template":
            return X.truth(col(name))
        if name == "is_powered_on":
            return X.powered_on(F.col("powerstate")) if "powerstate" in rows.columns else F.lit(True)
        if name in MEASURED:
            return X.number(col(name), None)
        if isinstance(field.dataType, T.StringType):
            return X.text_or_empty(col(name))
        return X.whole(col(name)) if isinstance(field.dataType, T.IntegerType) else X.number(col(name))

    extra = [F.col(c) for c in (*keep, *carry) if c in rows.columns]
    return rows.select(*[one(f).cast(f.dataType).alias(f.name) for f in CANONICAL], *extra)


def display_columns(df: DataFrame, columns: Collection[str]) -> DataFrame:
    """The columns of a display set that df has."""
    return df.select(*[c for c in columns if c in df.columns])
