"""Inventories, exports and their sheets as views of the star-schema tables, so that every operator has data at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIXES = ("SQL-SRV-", "ORACLE-DB-", "SAP-APP-", "VDI-PC-", "EXCHANGE-", "WEB-SRV-", "FILE-SRV-", "DOCKER-", "VEEAM-", "ELASTIC-", "APP-SRV-", "DC-", "CITRIX-", "PGSQL-", "MONGO-")
FOLDERS = ("", "/vm/SAP-prod", "/vm/EXCHANGE/old", "/vm/UCM", "/vm/NTNX-CVMs", "/vm/PowerFlex", "/vm/AD", "/vm/IPAM", "/vm/IAM", "/vm/HanaDB", "/vm/other")
DESCRIPTIONS = ("", "Nutanix Controller VM", "Dell PowerProtect appliance", "vSAN Witness", "FortiDeceptor", "BeyondTrust", "Tenable scanner", "OnCommand Unified Manager", "Horizon3.ai runner", "exotrack", "Cisco Unity Connection", "a note", "worker3")
SYSTEMS = ("Microsoft Windows Server 2019", "Red Hat Enterprise Linux 8", "Ubuntu 22.04", "Microsoft Windows Server 2022", "SUSE Linux Enterprise Server 15")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key to as many tasks as a shuffle has: a table that is one file of few row groups would else be worked on
    by as few tasks, however much is done with each row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def pick(values: tuple, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with the region and nation of their customer."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    where = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, sf_dir, "orders").join(where, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "r_name", "n_name")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A machine for each order: space from its line items, IOPS from the events of the user with its number."""
    k = F.col("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("lk")).agg(F.sum("l_quantity").alias("q"))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("ek")).agg((F.max("value") * 300).alias("peak_iops"), (F.round(F.avg("value"), 4) * 300).alias("avg_iops"))
    rows = dealt(placed_orders(spark, sf_dir), "o_orderkey").join(lines, k == F.col("lk"), "left").join(events, k == F.col("ek"), "left")
    q = F.coalesce("q", F.lit(0.0))
    return rows.select(
        k.alias("row_index"),
        F.concat(pick(PREFIXES, k), k.cast("string")).alias("vm_name"),
        F.when(k % 17 == 0, "").otherwise(pick(SYSTEMS, k)).alias("os_name"),
        F.when(k % 23 == 0, 0).otherwise(1 + k % 16).cast("int").alias("num_cpus"),
        ((k % 32) * 1024).cast("double").alias("memory_mib"),
        (q * 8192).alias("provisioned_mib"),
        (q * 4096).alias("in_use_mib"),
        F.col("r_name").alias("datacenter"),
        F.when(k % 29 == 0, "").otherwise(F.col("n_name")).alias("cluster"),
        (k % 41 == 0).alias("is_template"),
        (F.col("o_orderstatus") != "P").alias("is_powered_on"),
        (k % 22).cast("int").alias("hw_version"),
        F.when(k % 11 == 0, "toolsNotInstalled").when(k % 11 == 1, "toolsNotRunning").when(k % 11 == 2, "toolsOld").otherwise("toolsOk").alias("tools_status"),
        "peak_iops",
        "avg_iops",
    )


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory with folders and descriptions; every third name tells nothing, so that these decide."""
    k = F.col("row_index")
    name = F.when(k % 3 == 0, F.concat(F.lit("node"), k.cast("string"))).otherwise(F.col("vm_name"))
    return inventory(spark, sf_dir).withColumns({"vm_name": name, "vm_folder": pick(FOLDERS, k), "vm_description": pick(DESCRIPTIONS, k)})


def mixed_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory as a fleet in which the checks of clusters and of unknown machines find something: clusters of one or
    two machines, clusters of middling hardware alone, large machines of no known workload."""
    k = F.col("row_index")
    return inventory(spark, sf_dir).withColumns(
        {
            "cluster": F.when(k % 97 == 0, F.concat(F.lit("EDGE-"), F.expr("row_index div 194").cast("string"))).otherwise(F.col("cluster")),
            "hw_version": F.when(F.length("cluster") % 2 == 0, (14 + k % 6).cast("int")).otherwise(F.col("hw_version")),
            "provisioned_mib": F.col("provisioned_mib") * 4,
            "workload_category": F.when(k % 3 == 0, "Unknown (Reducible)").otherwise("Database"),
        }
    )


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory as an export: texts under an export's headers, some cells blank or no numbers."""
    i, k = inventory(spark, sf_dir), F.col("row_index")
    return i.select(
        F.col("vm_name").alias("VM "), F.when(F.col("is_powered_on"), "poweredOn").otherwise("poweredOff").alias("Powerstate"), F.when(k % 41 == 0, "True").when(k % 41 == 1, None).otherwise("False").alias("Template"),
        F.col("os_name").alias("OS according to the VMware Tools"), F.lit("other").alias("OS according to the configuration file"), F.when(k % 13 == 0, "n/a").otherwise(F.col("num_cpus").cast("string")).alias("CPUs"),
        F.col("memory_mib").cast("string").alias("Memory"), F.when(k % 19 == 0, "NaN").otherwise(F.col("provisioned_mib").cast("string")).alias("Provisioned MiB"), F.col("in_use_mib").cast("string").alias("In Use MiB"),
        F.col("datacenter").alias("Datacenter"), F.when(k % 29 == 0, None).otherwise(F.col("cluster")).alias("Cluster"), F.col("hw_version").cast("string").alias("HW version"),
    )


def second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the machines under other spellings, and as many that the inventory lacks."""
    k = F.col("o_orderkey") * 2
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        F.concat(F.lit(" "), F.lower(pick(PREFIXES, k)), k.cast("string"), F.lit(" ")).alias("vm_name"), F.lit("other os").alias("os_name"), F.lit(2).alias("num_cpus"), F.lit(2048.0).alias("memory_mib"),
        (k + 1).cast("double").alias("provisioned_mib"), F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise((k + 0.5).cast("double")).alias("in_use_mib"), F.lit("DC2").alias("datacenter"), F.lit("CL2").alias("cluster"),
        F.lit(False).alias("is_template"), F.lit(True).alias("is_powered_on"), F.lit("liveoptics_csv").alias("source_format"), (k * 10).cast("double").alias("peak_iops"), (k * 5).cast("double").alias("avg_iops"),
    )


def vm_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("mob_id"), (F.col("l_quantity") * 8192).cast("string").alias("capacity_mib"), (F.col("l_quantity") * 4096).cast("string").alias("used_mib"))


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2 AND l_orderkey % 4 <> 0")
    return li.select(F.col("l_orderkey").cast("string").alias("vm_uuid"), (F.col("l_quantity") * 10240).alias("capacity_mib"), (F.col("l_quantity") * 4096).alias("consumed_mib"))


def datastores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "vsan").otherwise("VMFS").alias("type"))


def with_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory with UUIDs and home datastores in its paths."""
    homes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("sk")).join(table(spark, sf_dir, "supplier"), F.col("sk") == F.col("s_suppkey"))
    found = inventory(spark, sf_dir).join(homes.select("l_orderkey", "s_name"), F.col("row_index") == F.col("l_orderkey"), "left")
    path = F.concat(F.lit("["), F.coalesce("s_name", F.lit("")), F.lit("] "), "vm_name", F.lit(".vmx"))
    return found.withColumns({"vm_uuid": F.col("row_index").cast("string"), "vm_path": path}).drop("l_orderkey", "s_name")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance samples of machines, several for a name."""
    e = table(spark, sf_dir, "events")
    name = F.concat(pick(PREFIXES, F.col("user_id")), F.col("user_id").cast("string"), F.lit(" "))
    return e.select(name.alias("vm_name"), (F.col("value") * 300).alias("peak_iops"), (F.col("value") * 8).alias("peak_throughput_kbs"), F.col("value").alias("peak_latency_ms"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0")
    return o.select(F.col("o_orderkey").alias("row_index"), F.lit("File").alias("workload_category"), F.lit("General Purpose").alias("workload_subcategory"), F.lit(2.0).alias("drr"), F.when(F.col("o_orderkey") % 100 == 0, True).alias("is_ignored"))


def third_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the machines under their own spelling, and twice as many that the inventory lacks; some are measured."""
    k, rows = F.col("o_orderkey") * 3, table(spark, sf_dir, "orders")
    return rows.select(
        F.concat(pick(PREFIXES, k), k.cast("string")).alias("vm_name"), F.lit("third os").alias("os_name"), F.lit(3).alias("num_cpus"), F.lit(4096.0).alias("memory_mib"), (k + 2).cast("double").alias("provisioned_mib"),
        F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise((k + 0.25).cast("double")).alias("in_use_mib"), F.lit("DC3").alias("datacenter"), F.lit("CL3").alias("cluster"), F.lit("liveoptics_csv").alias("source_format"),
        F.when(F.col("o_orderkey") % 4 != 0, (k * 7).cast("double")).alias("peak_iops"),
    )


def _fleet_ids() -> dict[str, Column]:
    number = F.expr("row_index div 7").cast("string")
    return {"mob_id": F.concat(F.lit("vm-"), number), "vm_uuid": F.when(F.col("row_index") % 3 == 0, "").otherwise(number)}


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory as an export for each datacenter, whose ids collide: seven neighbouring machines have one, in
    whatever export they are. Every third machine has no UUID."""
    return inventory(spark, sf_dir).withColumns({"source_file": F.col("datacenter")} | _fleet_ids())


def _fleet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and ids of fleet(), which need neither line items nor events."""
    k = F.col("o_orderkey")
    own = placed_orders(spark, sf_dir).select(k.alias("row_index"), F.col("r_name").alias("source_file"), F.concat(pick(PREFIXES, k), k.cast("string")).alias("vm_name"))
    return own.withColumns(_fleet_ids())


def fleet_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disks of fleet(); in one export some have no MOB id."""
    own = _fleet_names(spark, sf_dir)
    rows = table(spark, sf_dir, "lineitem").join(own, F.col("l_orderkey") == F.col("row_index"))
    blank = (F.col("source_file") == "EUROPE") & (F.col("l_linenumber") == 1)
    return rows.select("source_file", "vm_name", F.when(blank, " ").otherwise(F.col("mob_id")).alias("mob_id"), "vm_uuid", (F.col("l_quantity") * 8192).alias("capacity_mib"), (F.col("l_quantity") * 4096).alias("used_mib"))


def fleet_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _fleet_names(spark, sf_dir).drop("mob_id")
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2 AND l_orderkey % 4 <> 0").join(own, F.col("l_orderkey") == F.col("row_index"))
    return rows.select("source_file", "vm_name", "vm_uuid", (F.col("l_quantity") * 10240).alias("capacity_mib"), (F.col("l_quantity") * 4096).alias("consumed_mib"))


def fleet_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of machines by name, each from the export of one region."""
    e = table(spark, sf_dir, "events").join(F.broadcast(table(spark, sf_dir, "region")), F.col("user_id") % 5 == F.col("r_regionkey"))  # five rows
    return e.select(F.col("r_name").alias("source_file"), F.concat(pick(PREFIXES, F.col("user_id")), F.col("user_id").cast("string")).alias("vm_name"), (F.col("value") * 300).alias("peak_iops"), (F.col("value") * 8).alias("peak_throughput_kbs"))


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several edits of a machine, one for each of its line items, of changing columns."""
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_index"), n.alias("edit_no"), F.when(n % 3 == 1, F.concat(F.lit("edit "), n.cast("string"))).alias("workload_category"), F.when(n % 2 == 0, F.concat(F.lit("part "), (9 - n).cast("string"))).alias("workload_subcategory"),
        F.when(n % 4 != 3, 10.0 - n).alias("drr"), F.when(n >= 5, n % 2 == 1).alias("is_ignored"),
    )
