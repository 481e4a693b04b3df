"""One query for each operator, over whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasize.functions import expressions as X
from stratasize.functions import tables as T
from stratasize.operators import capacity as D
from stratasize.operators import classify as E
from stratasize.operators import filters as C
from stratasize.operators import health as H
from stratasize.operators import layout as J
from stratasize.operators import merge as M
from stratasize.operators import ratios as R
from stratasize.operators import reports as K
from stratasize.operators import sizing as S
from stratasize.operators.rule_index import rule_number_by_index
from stratasize.plans import fixtures as fx
from stratasize.plans import flows
from stratasize.plans import oracle as o
from stratasize.sources import columns as A
from stratasize.sources.sinks import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.classify(fx.inventory(spark, sf_dir))


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.size_machines(R.attach_ratio(classified(spark, sf_dir), T.ratios(spark)))
    return rows.withColumn("workload_key", X.workload_key(F.col("workload_category"), F.col("workload_subcategory")))


# Sources and scalar expressions


@query(f"""WITH {o.INVENTORY} SELECT vm_name, os_name, (CASE WHEN row_index % 13 = 0 THEN 0 ELSE num_cpus END)::INTEGER AS num_cpus, memory_mib,
    CASE WHEN row_index % 19 = 0 THEN 0 ELSE provisioned_mib END AS provisioned_mib, in_use_mib, datacenter, cluster, is_template, is_powered_on, hw_version, '' AS tools_status, 'rvtools' AS source_format FROM inv""")
def canonical_export(spark, sf_dir):
    rows = A.canonical(fx.exported(spark, sf_dir), A.RVTOOLS, "rvtools")
    return rows.select("vm_name", "os_name", "num_cpus", "memory_mib", "provisioned_mib", "in_use_mib", "datacenter", "cluster", "is_template", "is_powered_on", "hw_version", "tools_status", "source_format")


@query(f"WITH {o.INVENTORY} SELECT row_index AS machine, datacenter, row_number() OVER (PARTITION BY datacenter ORDER BY row_index) - 1 AS row_index FROM inv WHERE NOT is_template")
def row_identity(spark, sf_dir):
    rows = C.without_templates(fx.inventory(spark, sf_dir)).select(F.col("row_index").alias("machine"), "datacenter")
    return C.numbered(rows, ["machine"], ["datacenter"])


@query(f"WITH {o.INVENTORY} SELECT row_index AS machine, row_number() OVER (ORDER BY row_index) - 1 AS row_index FROM inv WHERE NOT is_template")
def global_row_identity(spark, sf_dir):
    return C.numbered_globally(C.without_templates(fx.inventory(spark, sf_dir)).select(F.col("row_index").alias("machine")), ["machine"])


@query(f"""WITH {o.INVENTORY}, h AS (SELECT l_orderkey, min(l_suppkey) AS sk FROM lineitem GROUP BY 1)
    SELECT row_index, coalesce(s_name, '') AS home FROM inv LEFT JOIN h ON row_index = l_orderkey LEFT JOIN supplier ON sk = s_suppkey""")
def home_datastores(spark, sf_dir):
    return fx.with_paths(spark, sf_dir).select("row_index", X.home_datastore(F.col("vm_path")).alias("home"))


@query(r"""SELECT p_partkey, CASE WHEN starts_with(p_name, 'ACME-') THEN 1 ELSE 0 END AS had, regexp_replace('Srv-' || p_name, '(?i)^(?:SRV|PC)[-_.]?', '') AS role_name,
    CASE WHEN regexp_matches(p_brand, '(?i)^Brand#') THEN regexp_replace(p_brand, '(?i)^Brand#', '') ELSE regexp_replace(p_brand, '(?i)^B', '') END AS short FROM part""")
def prefixes(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.when(F.col("p_name").startswith("ACME-"), 1).otherwise(0).alias("had"), X.without_role_prefix(F.concat(F.lit("Srv-"), "p_name")).alias("role_name"), X.without_company_prefix(F.col("p_brand"), ["^Brand#", "^B"]).alias("short"))


@query(f"""WITH {o.CLASSIFIED} SELECT row_index, trim(vm_name || CASE WHEN os_name <> '' THEN ' ' || os_name ELSE '' END) AS text, workload_category || ' / ' || workload_subcategory AS label,
    workload_category AS category, workload_subcategory AS subcategory FROM cls""")
def labels(spark, sf_dir):
    rows = E.text_of(classified(spark, sf_dir)).withColumn("label", X.workload_label(F.col("workload_category"), F.col("workload_subcategory")))
    return rows.select("row_index", "text", "label", X.label_category(F.col("label")).alias("category"), X.label_subcategory(F.col("label")).alias("subcategory"))


@query(r"""SELECT c_custkey, CASE WHEN f = '' THEN 'report' ELSE f END AS file_name, substr(sha256(c_name), 1, 12) AS pseudonym, CASE WHEN regexp_matches(c_acctbal::VARCHAR, '^[=+\-@\t\r]') THEN '''' || c_acctbal::VARCHAR ELSE c_acctbal::VARCHAR END AS cell
    FROM (SELECT *, regexp_replace(regexp_replace(c_name || ' / ' || c_mktsegment || '!', '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS f FROM customer)""")
def safe_names(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    return c.select("c_custkey", X.file_name(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("!"))).alias("file_name"), X.pseudonym(F.col("c_name")).alias("pseudonym"), X.safe_cell(F.col("c_acctbal").cast("string")).alias("cell"))


def _clean(x: str) -> str:
    return f"substr(coalesce(nullif(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'report'), 1, 20)"


@query(f"""WITH {o.SIZED}, f AS (SELECT category, arg_min(subcategory, table_order) AS first_sub FROM ratios GROUP BY 1) SELECT row_index, printf('%.1f TiB', provisioned_mib / 1048576) AS space, printf('%.1f%%', (row_index % 1000) / 1000.0::DOUBLE * 100) AS share,
    coalesce(first_sub, '') AS bare, {_clean("datacenter")} || '-' || {_clean("cluster")} || '-' || {_clean("vm_name")} || '-and1more' AS suffix FROM sized LEFT JOIN f ON workload_category = category""")
def display_texts(spark, sf_dir):
    """Space and shares as texts, the subcategory of a bare category, the suffix of a scope's file."""
    names = F.array("datacenter", "cluster", "vm_name", "os_name")
    return sized(spark, sf_dir).select(
        "row_index", X.tib_text(F.col("provisioned_mib")).alias("space"), X.percent_text(F.col("row_index") % 1000 / F.lit(1000.0)).alias("share"),
        X.label_subcategory(F.col("workload_category"), T.ratio_rows()).alias("bare"), X.scope_suffix(names).alias("suffix"),
    )


# Filters


@query(f"WITH {o.INVENTORY} SELECT row_index, vm_name FROM inv WHERE is_powered_on AND NOT is_template")
def active_machines(spark, sf_dir):
    return C.active(fx.inventory(spark, sf_dir)).select("row_index", "vm_name")


@query(f"WITH {o.INVENTORY} SELECT row_index, datacenter, cluster FROM inv WHERE datacenter IN ('ASIA', 'EUROPE') AND cluster IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)")
def scoped(spark, sf_dir):
    even = [r[0] for r in fx.table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_name").collect()]  # a scope of 13 names
    return C.in_scope(fx.inventory(spark, sf_dir), ["ASIA", "EUROPE"], even).select("row_index", "datacenter", "cluster")


@query(f"WITH {o.INVENTORY} SELECT count(*) FILTER (datacenter IN ('ASIA', 'EUROPE')) AS selected, count(*) AS total FROM inv")
def scope_preview(spark, sf_dir):
    return C.scope_preview(fx.inventory(spark, sf_dir), ["ASIA", "EUROPE"])


@query(f"WITH {o.INVENTORY} SELECT DISTINCT trim(cluster) AS cluster FROM inv WHERE trim(cluster) <> ''")
def scope_values(spark, sf_dir):
    return C.scope_values(fx.inventory(spark, sf_dir), "cluster")


@query(f"WITH {o.INVENTORY} SELECT row_index, vm_name FROM inv WHERE contains(lower(vm_name || ' ' || os_name), 'sql-srv')")
def searched(spark, sf_dir):
    return C.search(fx.inventory(spark, sf_dir), "SQL-Srv", ["vm_name", "os_name"]).select("row_index", "vm_name")


@query(f"""WITH {o.CLASSIFIED} SELECT row_index, os_name, num_cpus FROM cls WHERE row_index % 7 <> 0 AND classification_confidence = 'override' AND num_cpus BETWEEN 2 AND 8 AND lower(os_name) <> 'ubuntu 22.04'
    AND NOT ends_with(lower(vm_name), '3')""")
def filtered(spark, sf_dir):
    """The filters of a machine table, one after the other: not ignored, by confidence, by number, by text."""
    rows = C.with_confidence(C.without_ignored(classified(spark, sf_dir).withColumn("is_ignored", F.col("row_index") % 7 == 0)), ["override"])
    rows = C.where_text(C.where_number(rows, "num_cpus", "between", 2, 8), "os_name", "Ubuntu 22.04", "not_equals")
    return C.where_text(rows, "vm_name", "3", "not_ends").select("row_index", "os_name", "num_cpus")


@query(f"WITH {o.INVENTORY} SELECT datacenter, coalesce(bool_or(peak_iops > 0), false) AS measured FROM inv GROUP BY 1")
def measured(spark, sf_dir):
    return fx.inventory(spark, sf_dir).groupBy("datacenter").agg(C.has_measurements().alias("measured"))


# Joins and row updates

_SECOND = f"""second AS (SELECT lower({o.name("o_orderkey * 2")}) AS vm_name, (o_orderkey * 2 + 1)::DOUBLE AS provisioned_mib, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey * 2 + 0.5 END::DOUBLE AS in_use_mib,
    o_orderkey * 20.0::DOUBLE AS peak_iops FROM orders)"""


@query(f"""WITH {o.INVENTORY}, {_SECOND} SELECT coalesce(i.vm_name, s.vm_name) AS vm_name, coalesce(i.os_name, 'other os') AS os_name, coalesce(i.num_cpus, 2) AS num_cpus, coalesce(i.provisioned_mib, s.provisioned_mib) AS provisioned_mib,
    CASE WHEN s.in_use_mib > 0 THEN s.in_use_mib ELSE i.in_use_mib END AS in_use_mib, coalesce(i.datacenter, 'DC2') AS datacenter, coalesce(i.hw_version, 0) AS hw_version, coalesce(i.tools_status, '') AS tools_status,
    coalesce(i.is_template, false) AS is_template, s.peak_iops, 'merged' AS source_format FROM inv i FULL JOIN second s ON lower(i.vm_name) = s.vm_name""")
def merged_sources(spark, sf_dir):
    rows = M.merge_sources(fx.inventory(spark, sf_dir), fx.second_source(spark, sf_dir))
    return rows.select("vm_name", "os_name", "num_cpus", "provisioned_mib", "in_use_mib", "datacenter", "hw_version", "tools_status", "is_template", "peak_iops", "source_format")


@query(ORACLE_SQL["merged_sources"])
def merged_skewed_sources(spark, sf_dir):
    rows = M.merge_skewed_sources(fx.inventory(spark, sf_dir), fx.second_source(spark, sf_dir))
    return rows.select("vm_name", "os_name", "num_cpus", "provisioned_mib", "in_use_mib", "datacenter", "hw_version", "tools_status", "is_template", "peak_iops", "source_format")


@query(f"""WITH {o.INVENTORY}, {_SECOND} SELECT count(*) AS total, count(*) FILTER (i.vm_name IS NOT NULL AND s.vm_name IS NOT NULL) AS matched, count(*) FILTER (s.vm_name IS NULL) AS first_only,
    count(*) FILTER (i.vm_name IS NULL) AS second_only FROM inv i FULL JOIN second s ON lower(i.vm_name) = s.vm_name""")
def merge_statistics(spark, sf_dir):
    return M.merge_statistics(fx.inventory(spark, sf_dir), fx.second_source(spark, sf_dir))


@query(f"""WITH {o.INVENTORY}, d AS (SELECT l_orderkey AS k, sum(l_quantity * 8192) AS c, sum(l_quantity * 4096) AS u FROM lineitem GROUP BY 1)
    SELECT row_index, coalesce(c, provisioned_mib) AS provisioned_mib, coalesce(u, in_use_mib) AS in_use_mib FROM inv LEFT JOIN d ON row_index * 2 = k""")
def disk_override(spark, sf_dir):
    vms = fx.inventory(spark, sf_dir).withColumn("mob_id", (F.col("row_index") * 2).cast("string"))
    return D.override_by_disks(vms, fx.vm_disks(spark, sf_dir)).select("row_index", "provisioned_mib", "in_use_mib")


@query(f"""WITH {o.INVENTORY}, p AS (SELECT user_id AS k, max(value) * 300 AS peak, max(value * 8) AS kbs, max(value) AS latency FROM events GROUP BY 1)
    SELECT row_index, coalesce(peak, peak_iops) AS peak_iops, kbs / 1024 AS peak_throughput_mbs, latency AS peak_latency_ms, kbs / 8 AS iops_8k_equivalent FROM inv LEFT JOIN p ON row_index = k""")
def performance_attached(spark, sf_dir):
    rows = D.attach_performance(fx.inventory(spark, sf_dir), fx.samples(spark, sf_dir))
    return rows.select("row_index", "peak_iops", "peak_throughput_mbs", "peak_latency_ms", "iops_8k_equivalent")


_GUEST = f"""{o.INVENTORY}, p AS (SELECT l_orderkey AS k, sum(l_quantity * 10240) AS c, sum(l_quantity * 4096) AS u FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 4 <> 0 GROUP BY 1),
    d AS (SELECT l_orderkey AS k, sum(l_quantity * 8192) AS c FROM lineitem GROUP BY 1), b AS (SELECT inv.*, greatest(coalesce(p.c, 0), coalesce(d.c, 0)) AS known, p.u FROM inv LEFT JOIN p ON row_index = p.k LEFT JOIN d ON row_index = d.k),
    g AS (SELECT * REPLACE (CASE WHEN known > 0 THEN known ELSE provisioned_mib END AS provisioned_mib), provisioned_mib AS raw_provisioned_mib, known <= 0 AS capacity_fallback FROM b),
    guest AS (SELECT * REPLACE (least(coalesce(u, in_use_mib), provisioned_mib) AS in_use_mib) FROM g)"""


def _guest(spark, sf_dir) -> DataFrame:
    return D.guest_capacity(fx.with_paths(spark, sf_dir), fx.partitions(spark, sf_dir), fx.vm_disks(spark, sf_dir).withColumnRenamed("mob_id", "vm_uuid"))


@query(f"WITH {_GUEST} SELECT row_index, raw_provisioned_mib, provisioned_mib, in_use_mib, capacity_fallback FROM guest")
def guest_capacity(spark, sf_dir):
    return _guest(spark, sf_dir).select("row_index", "raw_provisioned_mib", "provisioned_mib", "in_use_mib", "capacity_fallback")


@query(f"""WITH {_GUEST}, h AS (SELECT l_orderkey, min(l_suppkey) AS sk FROM lineitem GROUP BY 1) SELECT count(*) AS total_vms, count(*) FILTER (capacity_fallback) AS fallback_count, sum(raw_provisioned_mib) AS pre_provisioned_mib,
    sum(provisioned_mib) AS post_provisioned_mib, sum(in_use_mib) AS post_in_use_mib, count(*) FILTER (sk % 3 = 0) AS vsan_vm_count, abs(sum(raw_provisioned_mib) - sum(provisioned_mib)) > 0.5 AS changed FROM guest LEFT JOIN h ON row_index = l_orderkey""")
def capacity_report(spark, sf_dir):
    return D.capacity_report(_guest(spark, sf_dir), fx.datastores(spark, sf_dir))


_FLEET = f"""{o.INVENTORY}, fl AS (SELECT *, datacenter AS site, 'vm-' || (row_index // 7) AS mob, CASE WHEN row_index % 3 = 0 THEN '' ELSE (row_index // 7)::VARCHAR END AS uuid FROM inv),
    dk AS (SELECT site, mob, uuid, vm_name, l_quantity * 8192 AS c, l_quantity * 4096 AS u FROM lineitem JOIN fl ON l_orderkey = row_index)"""


@query(f"""WITH {_FLEET}, i AS (SELECT site, mob, sum(c) AS c, sum(u) AS u FROM dk WHERE site <> 'EUROPE' GROUP BY 1, 2), n AS (SELECT site, vm_name, sum(c) AS c, sum(u) AS u FROM dk WHERE site = 'EUROPE' GROUP BY 1, 2)
    SELECT row_index, fl.site AS source_file, coalesce(i.c, n.c, provisioned_mib) AS provisioned_mib, coalesce(i.u, n.u, in_use_mib) AS in_use_mib FROM fl LEFT JOIN i ON fl.site = i.site AND fl.mob = i.mob LEFT JOIN n ON fl.site = n.site AND fl.vm_name = n.vm_name""")
def fleet_disk_override(spark, sf_dir):
    """Ids collide over exports; one export has disks without ids, so it joins by name."""
    return D.override_by_disks(fx.fleet(spark, sf_dir), fx.fleet_disks(spark, sf_dir), ["source_file"]).select("row_index", "source_file", "provisioned_mib", "in_use_mib")


@query(f"""WITH {_FLEET}, p AS (SELECT r_name AS site, user_id AS k, max(value) * 300 AS peak, max(value * 8) AS kbs FROM events JOIN region ON user_id % 5 = r_regionkey GROUP BY 1, 2)
    SELECT row_index, fl.site AS source_file, coalesce(peak, peak_iops) AS peak_iops, kbs / 1024 AS peak_throughput_mbs FROM fl LEFT JOIN p ON fl.site = p.site AND row_index = k""")
def fleet_performance(spark, sf_dir):
    return D.attach_performance(fx.fleet(spark, sf_dir), fx.fleet_samples(spark, sf_dir), ["source_file"]).select("row_index", "source_file", "peak_iops", "peak_throughput_mbs")


_FLEET_GUEST = f"""{_FLEET}, pt AS (SELECT site, uuid, vm_name, l_quantity * 10240 AS c, l_quantity * 4096 AS u FROM lineitem JOIN fl ON l_orderkey = row_index WHERE l_linenumber <= 2 AND l_orderkey % 4 <> 0),
    pu AS (SELECT site, uuid, sum(c) AS c, sum(u) AS u FROM pt WHERE uuid <> '' GROUP BY 1, 2), pn AS (SELECT site, vm_name, sum(c) AS c, sum(u) AS u FROM pt GROUP BY 1, 2), du AS (SELECT site, uuid, sum(c) AS c FROM dk WHERE uuid <> '' GROUP BY 1, 2),
    dn AS (SELECT site, vm_name, sum(c) AS c FROM dk GROUP BY 1, 2), b AS (SELECT fl.*, greatest(coalesce(pu.c, pn.c, 0), coalesce(du.c, dn.c, 0)) AS known, coalesce(pu.u, pn.u) AS u FROM fl LEFT JOIN pu ON fl.site = pu.site AND fl.uuid = pu.uuid
    LEFT JOIN pn ON fl.site = pn.site AND fl.vm_name = pn.vm_name LEFT JOIN du ON fl.site = du.site AND fl.uuid = du.uuid LEFT JOIN dn ON fl.site = dn.site AND fl.vm_name = dn.vm_name),
    g AS (SELECT * REPLACE (CASE WHEN known > 0 THEN known ELSE provisioned_mib END AS provisioned_mib), provisioned_mib AS raw, known <= 0 AS fallback FROM b), guest AS (SELECT * REPLACE (least(coalesce(u, in_use_mib), provisioned_mib) AS in_use_mib) FROM g)"""


def _fleet_guest(spark, sf_dir) -> DataFrame:
    return D.guest_capacity(fx.fleet(spark, sf_dir), fx.fleet_partitions(spark, sf_dir), fx.fleet_disks(spark, sf_dir).drop("mob_id"), ["source_file"])


@query(f"WITH {_FLEET_GUEST} SELECT row_index, site AS source_file, provisioned_mib, in_use_mib, fallback AS capacity_fallback FROM guest")
def fleet_guest_capacity(spark, sf_dir):
    """By UUID where a machine has one, else by name, within its export."""
    return _fleet_guest(spark, sf_dir).select("row_index", "source_file", "provisioned_mib", "in_use_mib", "capacity_fallback")


@query(f"""WITH {_FLEET_GUEST} SELECT site AS source_file, count(*) AS total_vms, count(*) FILTER (fallback) AS fallback_count, sum(raw) AS pre_provisioned_mib, sum(provisioned_mib) AS post_provisioned_mib, sum(in_use_mib) AS post_in_use_mib,
    0::BIGINT AS vsan_vm_count, abs(sum(raw) - sum(provisioned_mib)) > 0.5 AS changed FROM guest GROUP BY 1""")
def fleet_capacity_report(spark, sf_dir):
    return D.capacity_report(_fleet_guest(spark, sf_dir), by=["source_file"])


_THIRD = f"""third AS (SELECT lower({o.name("o_orderkey * 3")}) AS vm_name, (o_orderkey * 3 + 2)::DOUBLE AS provisioned_mib, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey * 3 + 0.25 END::DOUBLE AS in_use_mib,
    CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey * 21)::DOUBLE END AS peak_iops, {o.name("o_orderkey * 3")} AS spelled FROM orders)"""


@query(f"""WITH {o.INVENTORY}, {_SECOND}, {_THIRD}, k AS (SELECT lower(vm_name) AS k FROM inv UNION SELECT vm_name FROM second UNION SELECT vm_name FROM third)
    SELECT coalesce(i.vm_name, s.vm_name, t.spelled) AS vm_name, coalesce(i.os_name, CASE WHEN s.vm_name IS NOT NULL THEN 'other os' ELSE 'third os' END) AS os_name, coalesce(i.num_cpus, CASE WHEN s.vm_name IS NOT NULL THEN 2 ELSE 3 END) AS num_cpus,
    coalesce(i.provisioned_mib, s.provisioned_mib, t.provisioned_mib) AS provisioned_mib, CASE WHEN t.in_use_mib > 0 THEN t.in_use_mib WHEN s.in_use_mib > 0 THEN s.in_use_mib ELSE i.in_use_mib END AS in_use_mib,
    coalesce(i.datacenter, CASE WHEN s.vm_name IS NOT NULL THEN 'DC2' ELSE 'DC3' END) AS datacenter, coalesce(i.hw_version, 0) AS hw_version, coalesce(t.peak_iops, s.peak_iops) AS peak_iops, 'merged' AS source_format
    FROM k LEFT JOIN inv i ON k = lower(i.vm_name) LEFT JOIN second s ON k = s.vm_name LEFT JOIN third t ON k = t.vm_name""")
def folded_sources(spark, sf_dir):
    """Three sources, by priority, in one grouped aggregation."""
    first = fx.inventory(spark, sf_dir).drop("peak_iops", "avg_iops")
    rows = M.fold_sources([first, fx.second_source(spark, sf_dir), fx.third_source(spark, sf_dir)])
    return rows.select("vm_name", "os_name", "num_cpus", "provisioned_mib", "in_use_mib", "datacenter", "hw_version", "peak_iops", "source_format")


@query(f"""WITH {o.INVENTORY}, {_SECOND}, {_THIRD}, u AS (SELECT lower(vm_name) AS k, 0 AS i FROM inv UNION SELECT vm_name, 1 FROM second UNION SELECT vm_name, 2 FROM third), g AS (SELECT k, string_agg(i::VARCHAR, '+' ORDER BY i) AS sources FROM u GROUP BY 1)
    SELECT sources, count(*) AS names FROM g GROUP BY 1""")
def fold_statistics(spark, sf_dir):
    return M.fold_statistics([fx.inventory(spark, sf_dir), fx.second_source(spark, sf_dir), fx.third_source(spark, sf_dir)])


@query(f"WITH {o.SIZED} SELECT row_index, drr, 2.0::DOUBLE AS flat, drr AS by_table FROM sized")
def ratio_lookup(spark, sf_dir):
    rows = R.attach_ratio(classified(spark, sf_dir), T.ratios(spark))
    flat = R.apply_storage_model(rows.withColumn("own", F.col("drr")), "powerflex", T.ratios(spark)).withColumnRenamed("drr", "flat")
    return R.apply_storage_model(flat, "powerstore", T.ratios(spark)).select("row_index", F.col("own").alias("drr"), "flat", F.col("drr").alias("by_table"))


@query(f"""WITH {o.SIZED}, {o.IOPS}, z AS (SELECT row_index, workload_key FROM sized WHERE peak_iops = 0) SELECT row_index, coalesce(iops, 50.0)::DOUBLE AS peak_iops, coalesce(iops, 50.0)::DOUBLE * 0.7::DOUBLE AS avg_iops
    FROM z LEFT JOIN iops_table USING (workload_key)""")
def default_iops(spark, sf_dir):
    return J.with_default_iops(sized(spark, sf_dir).where("peak_iops = 0"), T.iops(spark)).select("row_index", "peak_iops", "avg_iops")


@query(f"WITH {o.SIZED} SELECT row_index, peak_iops, avg_iops FROM sized")
def default_iops_not_needed(spark, sf_dir):
    return J.with_default_iops(sized(spark, sf_dir), T.iops(spark)).select("row_index", "peak_iops", "avg_iops")


@query(f"""WITH {o.SIZED} SELECT row_index, CASE WHEN row_index % 50 = 0 THEN 'File' ELSE workload_category END AS workload_category, CASE WHEN row_index % 50 = 0 THEN 'General Purpose' ELSE workload_subcategory END AS workload_subcategory,
    CASE WHEN row_index % 50 = 0 THEN 2.0 ELSE drr END::DOUBLE AS drr, row_index % 100 = 0 AS is_ignored FROM sized""")
def edited(spark, sf_dir):
    rows = R.apply_edits(sized(spark, sf_dir).withColumn("is_ignored", F.lit(False)), fx.edits(spark, sf_dir))
    return rows.select("row_index", "workload_category", "workload_subcategory", "drr", "is_ignored")


def _last(column: str, value: str, when: str) -> str:
    """The value of a machine's last edit that has one."""
    return f"arg_max({value}, l_linenumber) FILTER ({when}) AS {column}"


def _edited(upto: int) -> str:
    cols = ", ".join((_last("c", "'edit ' || l_linenumber", "l_linenumber % 3 = 1"), _last("s", "'part ' || (9 - l_linenumber)", "l_linenumber % 2 = 0"), _last("d", "10.0::DOUBLE - l_linenumber", "l_linenumber % 4 <> 3"), _last("g", "l_linenumber % 2 = 1", "l_linenumber >= 5")))
    return f"""WITH {o.SIZED}, e AS (SELECT l_orderkey AS k, {cols} FROM lineitem WHERE l_linenumber <= {upto} GROUP BY 1)
    SELECT row_index, coalesce(c, workload_category) AS workload_category, coalesce(s, workload_subcategory) AS workload_subcategory, coalesce(d, drr) AS drr, coalesce(g, false) AS is_ignored FROM sized LEFT JOIN e ON row_index = k"""


@query(_edited(99))
def edit_log(spark, sf_dir):
    """Several edits a machine; the last of each column counts."""
    rows = R.apply_edits(sized(spark, sf_dir).withColumn("is_ignored", F.lit(False)), fx.edit_log(spark, sf_dir))
    return rows.select("row_index", "workload_category", "workload_subcategory", "drr", "is_ignored")


@query(_edited(3))
def edit_log_until(spark, sf_dir):
    """The same as of the third edit."""
    rows = R.apply_edits(sized(spark, sf_dir).withColumn("is_ignored", F.lit(False)), fx.edit_log(spark, sf_dir), until=3)
    return rows.select("row_index", "workload_category", "workload_subcategory", "drr", "is_ignored")


@query(f"""WITH {o.SIZED} SELECT row_index, CASE WHEN row_index % 50 = 0 THEN 'Web Servers' ELSE workload_category END AS workload_category, CASE WHEN row_index % 50 = 0 THEN 1.5 ELSE drr END::DOUBLE AS drr, row_index % 50 = 0 AS is_ignored,
    greatest(CASE WHEN row_index % 50 = 0 THEN 1.5 ELSE drr END - 1.45, 0.1)::DOUBLE AS typed FROM sized""")
def reassigned(spark, sf_dir):
    ids = fx.edits(spark, sf_dir).select("row_index")
    rows = R.mark_ignored(R.reassign(sized(spark, sf_dir), ids, "Web Servers", "Content included", T.ratios(spark)), ids)
    return rows.select("row_index", "workload_category", "drr", "is_ignored", R.edited_ratio(F.col("drr") - 1.45).alias("typed"))


@query(f"""WITH {o.RATIOS}, w AS (SELECT o_orderkey AS row_index, unnest([o_orderkey % 5, o_orderkey % 7 + 5, 40 + o_orderkey % 11]) AS t FROM orders)
    SELECT row_index, min(coalesce(ratio, 5.0))::DOUBLE AS conservative_drr FROM w LEFT JOIN ratios ON t = table_order GROUP BY 1""")
def conservative_ratios(spark, sf_dir):
    k, rows = F.col("o_orderkey"), T.ratio_rows()
    known = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(s).alias("subcategory")) for _, c, s, _ in rows])
    none = F.struct(F.lit("no such").alias("category"), F.lit("workload").alias("subcategory"))
    at = lambda i: F.coalesce(F.try_element_at(known, (i + 1).cast("int")), none)
    vms = fx.table(spark, sf_dir, "orders").select(k.alias("row_index"), F.array(at(k % 5), at(k % 7 + 5), at(k % 11 + 40)).alias("workloads"))
    return R.conservative_ratio(vms, T.ratios(spark)).select("row_index", "conservative_drr")


# Classification


@query(f"WITH {o.CLASSIFIED} SELECT row_index, vm_name, workload_category, workload_subcategory, classification_rule, classification_confidence FROM cls")
def classified_by_rules(spark, sf_dir):
    return classified(spark, sf_dir).select("row_index", "vm_name", "workload_category", "workload_subcategory", "classification_rule", "classification_confidence")


@query(f"""WITH {o.CLASSIFIED}, r AS (SELECT row_index, replace(classification_rule, 'override:', '') AS rule, classification_confidence = 'override' AS hit, workload_category, os_name FROM cls) SELECT row_index,
    CASE WHEN hit THEN rule WHEN regexp_matches(os_name, '(?i)windows server') THEN 'Windows Server (OS fallback)' WHEN regexp_matches(os_name, '(?i)linux|ubuntu|suse|red hat') THEN 'Linux (OS fallback)' ELSE 'default' END AS classification_rule,
    CASE WHEN hit THEN 'rule_match' WHEN os_name <> '' THEN 'os_fallback' ELSE 'default' END AS classification_confidence FROM r""")
def classified_by_registry(spark, sf_dir):
    return E.classify_by_registry(fx.inventory(spark, sf_dir)).select("row_index", "classification_rule", "classification_confidence")


@query(f"""WITH {o.DESCRIBED} SELECT row_index, CASE WHEN coalesce(direct, told) IS NOT NULL THEN 'override:' || coalesce(direct, told) WHEN provisioned_mib >= 102400 THEN 'Large generic (>=100 GiB)' ELSE 'default' END AS classification_rule,
    CASE WHEN coalesce(direct, told) IS NOT NULL THEN 'override' ELSE 'default' END AS classification_confidence FROM said""")
def described_by_rules(spark, sf_dir):
    """Folders and descriptions decide where names tell nothing."""
    return E.classify(fx.described(spark, sf_dir)).select("row_index", "classification_rule", "classification_confidence")


@query(f"WITH {o.DESCRIBED} SELECT row_index, coalesce(direct, told, fallback) AS classification_rule FROM said")
def described_by_registry(spark, sf_dir):
    """A description wins over the fallback by OS."""
    return E.classify_by_registry(fx.described(spark, sf_dir)).select("row_index", "classification_rule")


def _by_index(rows: DataFrame) -> DataFrame:
    """The rule pack as a table with an index of literals, as for packs of thousands."""
    rules = E._ordered(None)
    found = rule_number_by_index(rows, rules, E._signals(rows, ()))
    return found.select("row_index", F.coalesce("__rule_name", F.lit("default")).alias("classification_rule"), F.coalesce("__rule_confidence", F.lit("default")).alias("classification_confidence"))


@query(ORACLE_SQL["classified_by_registry"])
def classified_by_rule_index(spark, sf_dir):
    return _by_index(fx.inventory(spark, sf_dir))


@query(ORACLE_SQL["described_by_registry"])
def described_by_rule_index(spark, sf_dir):
    return _by_index(fx.described(spark, sf_dir)).drop("classification_confidence")


@query(f"""WITH {o.CLASSIFIED}, u AS (SELECT 'classification_confidence' AS kind, classification_confidence AS value FROM cls UNION ALL SELECT 'workload_category', workload_category FROM cls UNION ALL SELECT 'workload_subcategory', workload_subcategory FROM cls)
    SELECT kind, value, count(*) AS vms FROM u GROUP BY 1, 2""")
def distributions(spark, sf_dir):
    return E.distribution(classified(spark, sf_dir))


def _routes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All vectors, and each label's mean vector as its route's exemplar."""
    v = fx.table(spark, sf_dir, "embeddings")
    route = F.concat(F.lit("route"), F.col("label").cast("string"))
    means = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    means = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s"))
    exemplars = means.select(route.alias("route"), F.lit("c").alias("category"), F.lit("s").alias("subcategory"), F.transform("s", lambda x: x["m"]).alias("vector"))
    return v.select(F.col("vec_id").alias("row_index"), F.col("embedding").alias("vector"), route.alias("label")), exemplars


_BEST = """m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
    e AS (SELECT 'route' || label AS route, list(x ORDER BY i) AS b FROM m GROUP BY label),
    p AS (SELECT vec_id AS row_index, 'route' || label AS label, route, list_cosine_similarity(embedding::DOUBLE[], b::DOUBLE[]) AS c FROM embeddings, e),
    t AS (SELECT *, row_number() OVER (PARTITION BY row_index, route ORDER BY c DESC) AS n FROM p), s AS (SELECT row_index, label, route, avg(c) AS score FROM t WHERE n <= 1 GROUP BY ALL),
    best AS (SELECT row_index, label, route, score FROM (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY score DESC, route) AS n FROM s) WHERE n = 1)"""


@query(f"WITH {_BEST} SELECT row_index, route, round(score, 6) AS score FROM best")
def similarity_routes(spark, sf_dir):
    rows, exemplars = _routes(spark, sf_dir)
    return rounded(E.best_routes(rows, exemplars).select("row_index", "route", "score"), 6)


def _scored(spark, sf_dir, digits: int = 6) -> DataFrame:
    """Each vector's best route and its score, with its label."""
    rows, exemplars = _routes(spark, sf_dir)
    return rounded(E.best_routes(rows, exemplars), digits).join(rows.select("row_index", "label"), "row_index")


@query(f"""WITH {_BEST}, g AS (SELECT *, unnest([0.1, 0.2, 0.3, 0.5])::DOUBLE AS threshold FROM best) SELECT route, threshold, count(*) AS rows, count(*) FILTER (score >= threshold) AS accepted, count(*) FILTER (score >= threshold AND route = label) AS right
    FROM g GROUP BY 1, 2""".replace("AS right", 'AS "right"'))
def threshold_grid(spark, sf_dir):
    return E.evaluate_thresholds(_scored(spark, sf_dir, 15), [0.1, 0.2, 0.3, 0.5]).select("route", "threshold", "rows", "accepted", "right")


@query(f"""WITH {_BEST}, r AS (SELECT route, label, round(score, 6) AS score FROM best), d AS (SELECT route, score AS threshold, count(*) AS n, count(*) FILTER (route = label) AS h FROM r GROUP BY 1, 2)
    SELECT route, threshold, sum(n) OVER (PARTITION BY route)::BIGINT AS rows, sum(n) OVER w::BIGINT AS accepted, sum(h) OVER w::BIGINT AS "right" FROM d WINDOW w AS (PARTITION BY route ORDER BY threshold DESC)""")
def swept_thresholds(spark, sf_dir):
    """Each score as its route's threshold."""
    return E.sweep_thresholds(_scored(spark, sf_dir)).select("route", "threshold", "rows", "accepted", "right")


@query(f"""WITH {_BEST}, r AS (SELECT route, label, round(score, 6) AS score FROM best), g AS (SELECT a.route, a.score AS threshold, count(*) FILTER (b.score >= a.score) AS accepted, count(*) FILTER (b.score >= a.score AND b.route = b.label) AS hits, count(*) AS rows
    FROM (SELECT DISTINCT route, score FROM r) a JOIN r b USING (route) GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY hits / accepted DESC, accepted DESC, threshold DESC) AS n FROM g)
    SELECT route, threshold, round(hits / accepted, 6) AS accuracy, round(accepted / rows, 6) AS coverage FROM x WHERE n = 1""")
def fitted_thresholds(spark, sf_dir):
    return rounded(E.fit_thresholds(_scored(spark, sf_dir)), 6)


@query(f"""WITH {o.CLASSIFIED}, x(category, subcategory) AS (VALUES {", ".join(f"({o.text(c)}, {o.text(s)})" for c, s, _ in T.EXEMPLARS)})
    SELECT 'learned:' || category || '/' || subcategory AS route, count(DISTINCT vm_name) AS names FROM cls JOIN x ON workload_category = category AND workload_subcategory = subcategory WHERE classification_confidence = 'override' GROUP BY 1""")
def learned_routes(spark, sf_dir):
    found = E.learned_exemplars(classified(spark, sf_dir), T.exemplars(spark)).where(F.col("route").startswith("learned:"))
    return found.groupBy("route").agg(F.count(F.lit(1)).alias("names"))


@query()
def classified_with_similarity(spark, sf_dir):
    return flows.classified(fx.inventory(spark, sf_dir), T.exemplars(spark)).select("row_index", "workload_category", "workload_subcategory", "classification_rule", "classification_confidence")


# Aggregations

_SUMS = "count(*) AS vm_count, round(sum(provisioned_mib), 4) AS total_provisioned_mib, round(sum(in_use_mib), 4) AS total_in_use_mib, round(sum(required_mib), 4) AS total_required_mib"


@query(f"WITH {o.SIZED} SELECT workload_category AS category, drr, {_SUMS} FROM sized GROUP BY 1, 2")
def workload_groups(spark, sf_dir):
    return rounded(S.workload_groups(sized(spark, sf_dir)))


@query(f"WITH {o.SIZED} SELECT datacenter, workload_category AS category, drr, {_SUMS} FROM sized GROUP BY 1, 2, 3")
def workload_groups_by_datacenter(spark, sf_dir):
    return rounded(S.workload_groups(sized(spark, sf_dir), ["datacenter"]))


@query(f"WITH {o.SIZED} SELECT workload_category AS category, {_SUMS}, round(sum(provisioned_mib) / sum(required_mib), 4) AS effective_drr FROM sized GROUP BY 1")
def category_rollup(spark, sf_dir):
    return rounded(S.category_rollup(sized(spark, sf_dir)))


@query(f"""WITH {o.SIZED} SELECT CASE WHEN grouping(workload_category) = 1 THEN 'TOTAL' ELSE workload_category END AS category, round(CASE WHEN grouping(workload_category) = 1 THEN sum(provisioned_mib) / sum(required_mib) ELSE drr END, 4) AS drr,
    {_SUMS}, grouping(workload_category)::INTEGER AS is_total FROM sized GROUP BY GROUPING SETS ((workload_category, drr), ())""")
def breakdown(spark, sf_dir):
    return rounded(S.breakdown(sized(spark, sf_dir)))


@query(f"""WITH {o.SIZED} SELECT count(*) AS total_vms, round(sum(provisioned_mib), 4) AS total_provisioned_mib, round(sum(in_use_mib), 4) AS total_in_use_mib, round(sum(required_mib), 4) AS total_required_mib,
    round(sum(provisioned_mib) / sum(required_mib), 4) AS weighted_avg_drr, round(sum(provisioned_mib) / count(*), 4) AS avg_vm_size_mib, round(sum(num_cpus) / count(*), 4) AS avg_vm_cpus, round(sum(memory_mib) / count(*), 4) AS avg_vm_memory_mib,
    round(sum(num_cpus)::DOUBLE, 4) AS total_cpus, round(sum(memory_mib), 4) AS total_memory_mib, (SELECT vm_name FROM sized ORDER BY provisioned_mib DESC, row_index LIMIT 1) AS largest_vm_name, max(provisioned_mib) AS largest_vm_provisioned_mib,
    round(sum(avg_iops), 4) AS total_avg_iops, round(max(peak_iops), 4) AS max_vm_peak_iops, (SELECT vm_name FROM sized ORDER BY peak_iops DESC, row_index LIMIT 1) AS max_vm_peak_iops_name, 0.0::DOUBLE AS peak_throughput_mbs,
    0.0::DOUBLE AS total_iops_8k_equivalent, true AS has_performance_data FROM sized""")
def grand_summary(spark, sf_dir):
    return rounded(S.grand_summary(sized(spark, sf_dir)).withColumn("total_cpus", F.col("total_cpus").cast("double")))


@query(f"""WITH {o.SIZED} SELECT count(*) FILTER (row_index % 100 <> 0) AS vm_count, sum(provisioned_mib) FILTER (row_index % 100 <> 0) AS total_provisioned_mib, round(avg(drr) FILTER (row_index % 100 <> 0), 4) AS mean_drr,
    round(sum(required_mib) FILTER (row_index % 100 <> 0), 4) AS effective_mib, count(*) FILTER (row_index % 100 = 0) AS ignored_count FROM sized""")
def review_cards(spark, sf_dir):
    return rounded(S.review_cards(sized(spark, sf_dir).withColumn("is_ignored", F.col("row_index") % 100 == 0)))


# Health checks

def _hits(by: str = "") -> str:
    """Findings as common table expressions; by: `datacenter, ` for those of each datacenter."""
    row = lambda check, met: f"SELECT {by}'{check}' AS check_id, '' AS cluster, row_index, vm_name FROM act WHERE {met}"
    rows = " UNION ALL ".join(
        row(check, met)
        for check, met in (
            ("data_quality.missing_os", "trim(os_name) = ''"), ("data_quality.zero_provisioned", "provisioned_mib = 0"), ("data_quality.missing_cpu", "num_cpus = 0"), ("data_quality.missing_ram", "memory_mib = 0"),
            ("sizing_risk.high_unknown_ratio", "workload_category LIKE 'Unknown%'"), ("sizing_risk.large_unknown_vms", "workload_category LIKE 'Unknown%' AND provisioned_mib >= 1048576"), ("sizing_risk.iops_budget_exceeded", "peak_iops > 100000"),
            ("best_practice.no_cluster", "trim(cluster) = ''"), ("best_practice.tools_not_installed", "tools_status = 'toolsNotInstalled'"), ("best_practice.tools_not_running", "tools_status = 'toolsNotRunning'"),
        )
    )
    same = " AND ".join(f"cnt.{c} = {{0}}.{c}" for c in by.strip(", ").split(",") if c) or "true"
    return f"""act AS (SELECT * FROM cls WHERE is_powered_on AND NOT is_template), cl AS (SELECT *, CASE WHEN trim(cluster) = '' THEN '(No Cluster)' ELSE cluster END AS lab FROM act),
    pc AS (SELECT {by}lab, count(*) FILTER (hw_version BETWEEN 1 AND 13) AS nv, count(*) FILTER (hw_version BETWEEN 14 AND 16) AS no, count(*) AS n FROM cl GROUP BY ALL),
    hit AS ({rows} UNION ALL SELECT {by}'best_practice.very_old_hw_version', lab, row_index, vm_name FROM cl WHERE hw_version BETWEEN 1 AND 13
    UNION ALL SELECT {by}'best_practice.old_hw_version', lab, row_index, vm_name FROM cl JOIN pc USING ({by}lab) WHERE nv = 0 AND hw_version BETWEEN 14 AND 16
    UNION ALL SELECT {by}'best_practice.small_cluster_ha', lab, row_index, vm_name FROM cl JOIN pc USING ({by}lab) WHERE lab <> '(No Cluster)' AND n < 3),
    cnt AS (SELECT {by}check_id, cluster, count(*) AS affected_count, array_to_string(list(vm_name ORDER BY row_index)[1:5], ',') AS names FROM hit GROUP BY {by}check_id, cluster),
    fnd AS (SELECT {by}check_id, cluster, affected_count, names FROM cnt WHERE check_id <> 'sizing_risk.high_unknown_ratio' OR affected_count > 0.25 * (SELECT count(*) FROM act WHERE {same.format("act")})
    UNION ALL SELECT {by}'data_quality.high_powered_off_ratio', '', count(*) FILTER (NOT is_powered_on), '' FROM cls {f"GROUP BY {by.strip(', ')}" if by else ""} HAVING count(*) FILTER (NOT is_powered_on) > 0.3 * count(*))"""


_HIT = _hits()


@query(f"WITH {o.CLASSIFIED}, {_HIT} SELECT check_id, cluster, affected_count, names, (SELECT count(*) FROM act) AS checked_vms FROM fnd")
def health_findings(spark, sf_dir):
    return H.run_health_checks(classified(spark, sf_dir)).select("check_id", "cluster", "affected_count", F.array_join("affected_vms", ",").alias("names"), "checked_vms")


@query(f"""WITH {o.CLASSIFIED}, {_hits("datacenter, ")}, n AS (SELECT datacenter, count(*) AS checked_vms FROM act GROUP BY 1)
    SELECT datacenter, check_id, cluster, affected_count, names, checked_vms FROM fnd JOIN n USING (datacenter)""")
def fleet_findings(spark, sf_dir):
    found = H.run_health_checks(classified(spark, sf_dir), ["datacenter"])
    return found.select("datacenter", "check_id", "cluster", "affected_count", F.array_join("affected_vms", ",").alias("names"), "checked_vms")


@query(f"""WITH {o.INVENTORY}, cls AS (SELECT * REPLACE (CASE WHEN row_index % 97 = 0 THEN 'EDGE-' || (row_index // 194)::VARCHAR ELSE cluster END AS cluster, (CASE WHEN length(cluster) % 2 = 0 THEN 14 + row_index % 6 ELSE hw_version END)::INTEGER AS hw_version,
    provisioned_mib * 4 AS provisioned_mib), CASE WHEN row_index % 3 = 0 THEN 'Unknown (Reducible)' ELSE 'Database' END AS workload_category FROM inv), {_HIT} SELECT check_id, cluster, affected_count, names, (SELECT count(*) FROM act) AS checked_vms FROM fnd""")
def mixed_fleet_findings(spark, sf_dir):
    """Small clusters, middling hardware and large unknown machines, which health_findings has none of."""
    return H.run_health_checks(fx.mixed_fleet(spark, sf_dir)).select("check_id", "cluster", "affected_count", F.array_join("affected_vms", ",").alias("names"), "checked_vms")


@query(f"""WITH {o.CLASSIFIED}, {_HIT} SELECT CASE WHEN check_id IN ('best_practice.very_old_hw_version', 'best_practice.tools_not_installed') THEN 'critical' WHEN check_id IN ('data_quality.missing_cpu', 'data_quality.missing_ram',
    'data_quality.high_powered_off_ratio') THEN 'info' ELSE 'warning' END AS severity, count(*) AS count FROM fnd GROUP BY 1""")
def severity_counts(spark, sf_dir):
    return H.severity_counts(H.run_health_checks(classified(spark, sf_dir)))


# Layout


@query(f"""WITH {o.SIZED}, i AS (SELECT *, CASE WHEN contains(workload_key, 'HANA') THEN 'DS_HANA' WHEN contains(workload_key, 'Exchange') THEN 'DS_EXCHANGE' WHEN contains(workload_key, 'Oracle') THEN 'DS_ORA' ELSE 'DS_ISOLATED' END AS prefix FROM sized
    WHERE contains(workload_key, 'SAP HANA') OR contains(workload_key, 'Exchange') OR required_mib > 2097152 OR peak_iops > 5000) SELECT row_index, prefix || '_' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS datastore, round(required_mib / 0.68, 4) AS raw_mib
    FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY row_index) AS n FROM i)""")
def isolated_machines(spark, sf_dir):
    found = J.place_alone(sized(spark, sf_dir).where(J.isolated()), "performance", J.isolation_prefix(), J.Constraints())
    return rounded(found.select("row_index", "datastore", "raw_mib"))


@query(f"WITH {o.SIZED} SELECT CASE WHEN peak_iops > 500 OR workload_key LIKE 'Database%' THEN 'HOT' WHEN peak_iops >= 100 THEN 'WARM' ELSE 'COLD' END AS tier, count(*) AS vms FROM sized GROUP BY 1")
def tiers(spark, sf_dir):
    return sized(spark, sf_dir).groupBy(J.tier().alias("tier")).agg(F.count(F.lit(1)).alias("vms"))


def _part(parts: int) -> str:
    """A machine's part of so many, by a hash."""
    return f"('0x' || substr(md5(row_index::VARCHAR), 1, 6))::INTEGER % {parts}"


_CLASSES = f"""{o.SIZED}, dm AS (SELECT *, greatest(required_mib / (4194304 * (1 - 0.15::DOUBLE) * (1 - 0.2::DOUBLE)), peak_iops / 100000, 0.04::DOUBLE) AS demand FROM sized),
    kk AS (SELECT *, CASE WHEN demand > 1 THEN 1 ELSE greatest(floor(1 / demand + 1e-9), 1) END::INTEGER AS k FROM dm), ss AS (SELECT *, {_part(8)} AS salt FROM kk), nn AS (SELECT *, row_number() OVER (PARTITION BY k, salt ORDER BY required_mib DESC, row_index) - 1 AS n FROM ss),
    placed AS (SELECT *, 'DS_CLASS_' || k || '_' || salt || '_' || (n // k) AS datastore, 4194304 * (1 - 0.15::DOUBLE) * (1 - 0.2::DOUBLE) AS u FROM nn),
    stores AS (SELECT datastore, max(CASE WHEN required_mib > u THEN required_mib ELSE u END) AS usable_mib, sum(required_mib) AS used_mib, sum(peak_iops) AS total_iops, count(*) AS vm_count, count(DISTINCT workload_key) AS kinds FROM placed GROUP BY 1)"""


#: What layouts ask of a machine; a name where machines are listed.
_LAID = ("row_index", "cluster", "required_mib", "peak_iops", "avg_iops", "workload_key")


def _classes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = stored(sized(spark, sf_dir).select(*_LAID, "vm_name"), "sized")
    return J.place_by_classes(rows, J.Constraints(), salts=8), rows


def _class_stores(spark, sf_dir) -> DataFrame:
    """Datastores of classes; machines are read once, so they aren't written before."""
    return J.stores_by_classes(sized(spark, sf_dir), J.Constraints(), salts=8)


@query(f"WITH {_CLASSES} SELECT row_index, datastore FROM placed")
def placed_by_classes(spark, sf_dir):
    return J.place_by_classes(sized(spark, sf_dir), J.Constraints(), salts=8).select("row_index", "datastore")


@query(f"""WITH {_CLASSES} SELECT datastore, round(usable_mib, 4) AS usable_mib, round(used_mib, 4) AS used_mib, round(total_iops, 4) AS total_iops, vm_count, kinds, CASE WHEN used_mib / usable_mib * 100 > 80 THEN 'high'
    WHEN used_mib / usable_mib * 100 > 60 THEN 'middle' ELSE 'low' END AS band FROM stores""")
def datastores(spark, sf_dir):
    found = _class_stores(spark, sf_dir)
    return rounded(found.select("datastore", "usable_mib", "used_mib", "total_iops", "vm_count", F.size("workloads").cast("long").alias("kinds"), "band"))


@query(f"""WITH {_CLASSES} SELECT count(*) AS total_ds_count, round(avg(used_mib / usable_mib * 100), 4) AS avg_utilization_pct, round(avg(vm_count), 4) AS avg_vm_density, max(vm_count) AS max_vm_density, round(sum(total_iops), 4) AS total_iops_placed,
    round(count(*) FILTER (kinds <= 1) / count(*), 4) AS isolation_score, CASE WHEN avg(vm_count) <= 3 THEN 'fine' WHEN avg(vm_count) <= 10 THEN 'medium' ELSE 'coarse' END AS snapshot_granularity_rating FROM stores""")
def layout_metrics(spark, sf_dir):
    found = J.layout_metrics(_class_stores(spark, sf_dir))
    return rounded(found.select("total_ds_count", "avg_utilization_pct", "avg_vm_density", "max_vm_density", "total_iops_placed", "isolation_score", "snapshot_granularity_rating"))


#: The greedies, a machine a step, over all groups (cluster, strategy, label) at once; bins are lists.
_PROPOSED = f"""{o.SIZED}, c AS (SELECT 4194304 * ((1 - 0.15::DOUBLE) * (1 - 0.2::DOUBLE)) AS u, 100000.0::DOUBLE AS b),
    t AS (SELECT cluster, row_index, required_mib AS s, peak_iops AS p, workload_key AS w, u, b, required_mib > u AS big, contains(workload_key, 'SAP HANA') OR contains(workload_key, 'Exchange') OR required_mib > 2097152 OR peak_iops > 5000 AS iso,
        CASE WHEN peak_iops > 500 OR workload_key LIKE 'Database%' THEN 'HOT' WHEN peak_iops >= 100 THEN 'WARM' ELSE 'COLD' END AS tier FROM sized, c),
    pl AS (SELECT *, 'consolidation' AS strategy, 'DS_CONSOL' || CASE WHEN big THEN '_OVER' ELSE '' END AS label, big AS alone, 25 AS most FROM t UNION ALL SELECT *, 'uniform', 'DS_UNIFORM' || CASE WHEN big THEN '_OVER' ELSE '' END, big, 0 FROM t
        UNION ALL SELECT *, 'performance', CASE WHEN iso THEN CASE WHEN contains(w, 'HANA') THEN 'DS_HANA' WHEN contains(w, 'Exchange') THEN 'DS_EXCHANGE' WHEN contains(w, 'Oracle') THEN 'DS_ORA' ELSE 'DS_ISOLATED' END ELSE 'DS_' || tier || CASE WHEN big THEN '_OVER' ELSE '' END END,
        iso OR big, CASE WHEN tier = 'HOT' THEN 10 ELSE 25 END FROM t),
    od AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cluster, strategy, label ORDER BY CASE WHEN most = 0 THEN s ELSE greatest(s / u, p / b) END DESC, row_index) AS i FROM pl WHERE NOT alone),
    re AS (SELECT cluster, strategy, label, 0::BIGINT AS i, [0.0::DOUBLE for x in range(CASE WHEN any_value(most) = 0 THEN greatest(ceil(sum(s) / any_value(u)), ceil(sum(p) / any_value(b)), 1)::BIGINT ELSE 0 END)] AS used, []::DOUBLE[] AS busy, []::BIGINT[] AS n, NULL::BIGINT AS row_index, 0::BIGINT AS bin FROM od GROUP BY ALL
        UNION ALL SELECT cluster, strategy, label, i, CASE WHEN bin > len(used) THEN list_append(used, s) ELSE list_transform(used, lambda x, k: CASE WHEN k = bin THEN x + s ELSE x END) END,
            CASE WHEN bin > len(busy) THEN list_append(busy, p) ELSE list_transform(busy, lambda x, k: CASE WHEN k = bin THEN x + p ELSE x END) END, CASE WHEN bin > len(n) THEN list_append(n, 1) ELSE list_transform(n, lambda x, k: CASE WHEN k = bin THEN x + 1 ELSE x END) END, row_index, bin
        FROM (SELECT *, CASE WHEN most = 0 THEN CASE WHEN list_min(used) + s <= u THEN list_position(used, list_min(used)) ELSE len(used) + 1 END WHEN list_max(fits) >= 0 THEN list_position(fits, list_max(fits)) ELSE len(used) + 1 END::BIGINT AS bin
        FROM (SELECT re.cluster, re.strategy, re.label, od.i, used, busy, n, s, p, u, b, most, od.row_index, CASE WHEN most > 0 THEN list_transform(used, lambda x, k: CASE WHEN x + s <= u AND busy[k] + p <= b AND n[k] < most THEN x ELSE -1 END) END AS fits
        FROM re JOIN od ON re.cluster = od.cluster AND re.strategy = od.strategy AND re.label = od.label AND od.i = re.i + 1))),
    al AS (SELECT cluster, strategy, row_index, label, s, row_number() OVER (PARTITION BY cluster, strategy, label ORDER BY row_index) AS bin, u FROM pl WHERE alone),
    pr AS (SELECT cluster, strategy, row_index, label || '_' || CASE WHEN bin < 10 THEN '0' ELSE '' END || bin AS datastore, 4194304.0::DOUBLE AS raw_mib, u AS usable_mib, 'exact' AS packing FROM re, c WHERE row_index IS NOT NULL
        UNION ALL SELECT cluster, strategy, row_index, label || '_' || CASE WHEN bin < 10 THEN '0' ELSE '' END || bin, s / ((1 - 0.15::DOUBLE) * (1 - 0.2::DOUBLE)), s, 'alone' FROM al)"""


@query(f"WITH RECURSIVE {_PROPOSED} SELECT cluster, strategy, row_index, datastore, round(raw_mib, 4) AS raw_mib, round(usable_mib, 4) AS usable_mib, packing FROM pr")
def layout_proposals(spark, sf_dir):
    """The exact greedy, in parallel over clusters."""
    return rounded(J.all_proposals(sized(spark, sf_dir), T.iops(spark), groups=["cluster"]))


def _proposed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The figures of the three strategies over all clusters, and the machines."""
    rows = stored(sized(spark, sf_dir).select(*_LAID), "sized")
    return J.layout_metrics(J.all_stores(rows, T.iops(spark), groups=["cluster"], written=True)), rows


_PROPOSED_METRICS = f"""{_PROPOSED}, st AS (SELECT cluster, strategy, datastore, max(raw_mib) AS raw, max(usable_mib) AS usable, sum(required_mib) AS used, sum(peak_iops) AS iops, count(*) AS n, count(DISTINCT workload_key) AS kinds, contains(datastore, '_OVER_') AS over_
    FROM (SELECT pr.*, required_mib, peak_iops, workload_key FROM pr JOIN sized USING (row_index)) GROUP BY 1, 2, 3),
    mt AS (SELECT strategy, count(*) AS total_ds_count, sum(raw) AS total_raw_capacity_mib, sum(usable) AS total_usable_capacity_mib, sum(used) AS total_used_capacity_mib, avg(coalesce(used / nullif(usable, 0) * 100, 0)) AS avg_utilization_pct, min(coalesce(used / nullif(usable, 0) * 100, 0)) AS min_utilization_pct,
    max(coalesce(used / nullif(usable, 0) * 100, 0)) AS max_utilization_pct, avg(n) AS avg_vm_density, max(n) AS max_vm_density, sum(iops) AS total_iops_placed, max(iops) AS max_iops_single_ds, greatest(1 - max(iops) / 100000, 0) * 100 AS iops_headroom_pct,
    count(*) FILTER (kinds <= 1) / count(*) AS isolation_score, coalesce(sum(n) FILTER (over_), 0) AS oversized_vm_count FROM st GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_PROPOSED_METRICS}, v AS (SELECT strategy, unnest([{", ".join(f"'{m}'" for m in J.METRICS)}]) AS metric, unnest([{", ".join(f"{m}::DOUBLE" for m in J.METRICS)}]) AS x FROM mt)
    SELECT metric, {", ".join(f"round(max(x) FILTER (strategy = '{s}'), 2) AS {s}" for s in ("consolidation", "performance", "uniform"))} FROM v GROUP BY 1""")
def layout_comparison(spark, sf_dir):
    return rounded(J.comparison(_proposed(spark, sf_dir)[0]), 2)


@query(f"""WITH RECURSIVE {_PROPOSED_METRICS}, w AS (SELECT (SELECT count(DISTINCT workload_key) FROM sized) AS workloads, (SELECT isolation_score FROM mt WHERE strategy = 'performance') AS score)
    SELECT CASE WHEN workloads <= 1 THEN 'consolidation' WHEN score > 0.5 THEN 'performance' ELSE 'uniform' END AS strategy, workloads, round(score, 4) AS isolation_score FROM w""")
def layout_recommendation(spark, sf_dir):
    return rounded(J.recommend(*_proposed(spark, sf_dir)))


@query(f"""WITH {o.SIZED}, n AS (SELECT count(*) AS machines, round(sum(required_mib), 2) AS used_mib, count(*) FILTER (required_mib > 4194304 * (1 - 0.15::DOUBLE) * (1 - 0.2::DOUBLE)) AS beyond FROM sized)
    SELECT unnest(['consolidation', 'performance', 'uniform']) AS strategy, machines, machines AS distinct_machines, used_mib, 0::BIGINT AS over_space, 0::BIGINT AS over_iops, 0::BIGINT AS over_count FROM n""")
def layout_invariants(spark, sf_dir):
    """What holds for every layout: each machine is placed once, and no datastore of several machines exceeds a limit of
    its strategy (balancing has no limit of IOPS or of machines)."""
    c = J.Constraints()
    placement = stored(J.all_proposals(sized(spark, sf_dir), T.iops(spark), c, groups=["cluster"], described=True), "placement")
    several, packs = F.col("vm_count") > 1, F.col("strategy") != "uniform"
    stores = J.datastores(placement, groups=["cluster"]).groupBy("strategy").agg(
        F.sum("vm_count").alias("machines"), F.round(F.sum("used_mib"), 2).alias("used_mib"), F.count_if(several & (F.col("used_mib") > F.col("usable_mib") + 1e-6)).alias("over_space"),
        F.count_if(packs & several & (F.col("total_iops") > c.iops_budget + 1e-6)).alias("over_iops"), F.count_if(packs & (F.col("vm_count") > c.max_machines)).alias("over_count"),
    )
    distinct = placement.groupBy("strategy").agg(F.count_distinct("row_index").alias("distinct_machines"))
    return stores.join(distinct, "strategy").select("strategy", "machines", "distinct_machines", "used_mib", "over_space", "over_iops", "over_count")


#: Machines in a datastore for each of three class placements, which are compared like strategies.
_DENSITIES = {"consolidation": 50, "performance": 2, "uniform": 10}
_RATIO = "((1 - 0.15::DOUBLE) * (1 - 0.2::DOUBLE))"


def _class_placement(strategy: str, most: int) -> str:
    demand = f"greatest(required_mib / (4194304 * {_RATIO}), peak_iops / 100000, 1.0::DOUBLE / {most})"
    kinds = f"SELECT *, CASE WHEN {demand} > 1 THEN 1 ELSE greatest(floor(1 / {demand} + 1e-9), 1) END::INTEGER AS k, {_part(8)} AS salt FROM sized"
    return f"SELECT '{strategy}' AS strategy, k || '_' || salt || '_' || ((row_number() OVER (PARTITION BY k, salt ORDER BY required_mib DESC, row_index) - 1) // k) AS datastore, required_mib, peak_iops, workload_key FROM ({kinds})"


_COMPARED = f"""{o.SIZED}, pl AS ({" UNION ALL ".join(_class_placement(s, n) for s, n in _DENSITIES.items())}),
    st AS (SELECT strategy, datastore, max(CASE WHEN required_mib > 4194304 * {_RATIO} THEN required_mib / {_RATIO} ELSE 4194304 END) AS raw, max(greatest(required_mib, 4194304 * {_RATIO})) AS usable, sum(required_mib) AS used, sum(peak_iops) AS iops,
    count(*) AS n, count(DISTINCT workload_key) AS kinds FROM pl GROUP BY 1, 2),
    mt AS (SELECT strategy, count(*) AS total_ds_count, sum(raw) AS total_raw_capacity_mib, sum(usable) AS total_usable_capacity_mib, sum(used) AS total_used_capacity_mib, avg(used / usable * 100) AS avg_utilization_pct, min(used / usable * 100) AS min_utilization_pct,
    max(used / usable * 100) AS max_utilization_pct, avg(n) AS avg_vm_density, max(n) AS max_vm_density, sum(iops) AS total_iops_placed, max(iops) AS max_iops_single_ds, greatest(1 - max(iops) / 100000, 0) * 100 AS iops_headroom_pct,
    count(*) FILTER (kinds <= 1) / count(*) AS isolation_score, 0 AS oversized_vm_count FROM st GROUP BY 1)"""


def _compared(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The figures of three class placements, and the machines."""
    rows, figures = stored(sized(spark, sf_dir).select(*_LAID), "sized"), None
    for strategy, most in _DENSITIES.items():
        one = J.layout_metrics(J.stores_by_classes(rows, J.Constraints(max_machines=most), salts=8, strategy=strategy))
        figures = one if figures is None else figures.unionByName(one)
    return figures, rows


@query(f"""WITH {_COMPARED}, v AS (SELECT strategy, unnest([{", ".join(f"'{m}'" for m in J.METRICS)}]) AS metric, unnest([{", ".join(f"{m}::DOUBLE" for m in J.METRICS)}]) AS x FROM mt)
    SELECT metric, {", ".join(f"round(max(x) FILTER (strategy = '{s}'), 2) AS {s}" for s in _DENSITIES)} FROM v GROUP BY 1""")
def class_comparison(spark, sf_dir):
    return rounded(J.comparison(_compared(spark, sf_dir)[0]), 2)


@query(f"""WITH {_COMPARED}, w AS (SELECT (SELECT count(DISTINCT workload_key) FROM sized) AS workloads, (SELECT isolation_score FROM mt WHERE strategy = 'performance') AS score)
    SELECT CASE WHEN workloads <= 1 THEN 'consolidation' WHEN score > 0.5 THEN 'performance' ELSE 'uniform' END AS strategy, workloads, round(score, 4) AS isolation_score FROM w""")
def class_recommendation(spark, sf_dir):
    return rounded(J.recommend(*_compared(spark, sf_dir)))


_DEALT = f"""{o.SIZED}, normal AS (SELECT * FROM sized WHERE required_mib <= 4194304 * (1 - 0.15::DOUBLE) * (1 - 0.2::DOUBLE)), c AS (SELECT greatest(1, ceil(count(*) / 2000.0))::INTEGER AS parts FROM normal),
    p AS (SELECT normal.*, ('0x' || substr(md5(row_index::VARCHAR), 1, 6))::INTEGER % parts AS part FROM normal, c),
    b AS (SELECT part, least(ceil(greatest(ceil(sum(required_mib) / (4194304 * (1 - 0.15::DOUBLE) * (1 - 0.2::DOUBLE))), ceil(sum(peak_iops) / 100000.0::DOUBLE), 1) * 1.1::DOUBLE), count(*))::BIGINT AS bins FROM p GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY required_mib DESC, row_index) - 1 AS r FROM p JOIN b USING (part)),
    d AS (SELECT *, CASE WHEN (r // bins) % 2 = 0 THEN r % bins ELSE bins - 1 - r % bins END AS bin FROM r), full_ AS (SELECT part, bin, sum(required_mib) > 4194304 * (1 - 0.15::DOUBLE) * (1 - 0.2::DOUBLE) AS over_capacity FROM d GROUP BY 1, 2)"""


@query(f"WITH {_DEALT} SELECT row_index, 'DS_DEALT_' || part || '_' || (bin + 1) AS datastore, over_capacity FROM d JOIN full_ USING (part, bin)")
def dealt_evenly(spark, sf_dir):
    return J.deal_evenly(stored(sized(spark, sf_dir), "sized"), J.Constraints(), part_machines=2000).select("row_index", "datastore", "over_capacity")


@query(f"""WITH {_DEALT}, z AS (SELECT d.*, over_capacity, sum(required_mib) OVER (PARTITION BY part, bin ORDER BY required_mib DESC, row_index) AS upto, 4194304 * (1 - 0.15::DOUBLE) * (1 - 0.2::DOUBLE) AS u FROM d JOIN full_ USING (part, bin)),
    hd AS (SELECT *, greatest(required_mib / u, peak_iops / 100000, 0.04::DOUBLE) AS demand FROM z WHERE over_capacity AND upto > u), kk AS (SELECT *, CASE WHEN demand > 1 THEN 1 ELSE greatest(floor(1 / demand + 1e-9), 1) END::INTEGER AS k, {_part(8)} AS salt FROM hd)
    SELECT row_index, 'DS_DEALT_' || part || '_' || (bin + 1) AS datastore, false AS handed_over FROM z WHERE NOT (over_capacity AND upto > u)
    UNION ALL SELECT row_index, 'DS_DEALT_MORE_' || k || '_' || salt || '_' || ((row_number() OVER (PARTITION BY k, salt ORDER BY required_mib DESC, row_index) - 1) // k), true FROM kk""")
def dealt_fully(spark, sf_dir):
    """No datastore above its space: what is too much goes to classes."""
    return J.deal_fully(stored(sized(spark, sf_dir), "sized"), J.Constraints(), part_machines=2000).select("row_index", "datastore", "handed_over")


@query(f"WITH {_CLASSES} SELECT 'classes' AS strategy, datastore, row_index, vm_name, workload_key, round(required_mib, 4) AS required_mib, peak_iops FROM placed")
def drill_down(spark, sf_dir):
    return J.drill_down(*_classes(spark, sf_dir)).withColumn("required_mib", F.round("required_mib", 4))


# Report datasets

_GROUPS = f"""{o.SIZED}, g AS (SELECT workload_category AS category, drr, sum(provisioned_mib) AS p, sum(required_mib) AS r, sum(in_use_mib) AS u, count(*) AS n FROM sized GROUP BY 1, 2),
    nd AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY category) > 1 THEN category || printf(' (%.1fx)', drr) ELSE category END AS node FROM g)"""


@query(f"WITH {_GROUPS} SELECT 'Provisioned' AS source, node AS target, round(p / 1024, 1) AS gib FROM nd UNION ALL SELECT node, 'Required', round(r / 1024, 1) FROM nd")
def flow_edges(spark, sf_dir):
    return K.flow_edges(S.workload_groups(sized(spark, sf_dir)))


@query(f"""WITH {o.SIZED}, g AS (SELECT sum(provisioned_mib) AS p, sum(required_mib) AS r FROM sized WHERE workload_category = 'File')
    SELECT 'Before' AS source, 'File' AS target, round(p / 1024, 1) AS gib FROM g UNION ALL SELECT 'After', 'File', round(r / 1024, 1) FROM g""")
def flow_edges_of_one(spark, sf_dir):
    """A single group is shown before and after instead."""
    return K.flow_edges(S.workload_groups(sized(spark, sf_dir).where("workload_category = 'File'")))


@query(f"WITH {_GROUPS} SELECT node, round(p / 1024, 1) AS gib, round(p / sum(p) OVER (), 6) AS share FROM nd")
def group_shares(spark, sf_dir):
    return rounded(K.shares(S.workload_groups(sized(spark, sf_dir))), 6)


@query(f"WITH {_GROUPS} SELECT node, drr, round(p / 1024, 1) AS provisioned_gib, round(r / 1024, 1) AS required_gib FROM nd")
def group_bars(spark, sf_dir):
    groups = S.workload_groups(sized(spark, sf_dir))
    return K.ratios_by_group(groups).join(K.provisioned_and_required(groups), "node")


@query(f"""WITH {o.SIZED}, g AS (SELECT count(*) AS n, sum(num_cpus) AS cpus, sum(memory_mib) AS mem, sum(provisioned_mib) AS p, sum(in_use_mib) AS u, sum(required_mib) AS r, sum(avg_iops) AS a, max(peak_iops) AS peak FROM sized),
    big AS (SELECT vm_name AS name FROM sized ORDER BY provisioned_mib DESC, row_index LIMIT 1), hot AS (SELECT vm_name || ' (' || format('{{:,}}', round(peak_iops)::BIGINT) || ')' AS name FROM sized ORDER BY peak_iops DESC, row_index LIMIT 1),
    x AS (SELECT unnest([{{'position': 0, 'metric': 'total_vms', 'number': n::DOUBLE, 'text': NULL}}, {{'position': 1, 'metric': 'total_cpus', 'number': cpus::DOUBLE, 'text': NULL}}, {{'position': 2, 'metric': 'total_memory_gib', 'number': mem / 1024, 'text': NULL}},
    {{'position': 3, 'metric': 'total_provisioned_gib', 'number': p / 1024, 'text': NULL}}, {{'position': 4, 'metric': 'total_in_use_gib', 'number': u / 1024, 'text': NULL}}, {{'position': 5, 'metric': 'required_capacity_gib', 'number': r / 1024, 'text': NULL}},
    {{'position': 6, 'metric': 'avg_cpus', 'number': cpus / n, 'text': NULL}}, {{'position': 7, 'metric': 'avg_memory_gib', 'number': mem / n / 1024, 'text': NULL}}, {{'position': 8, 'metric': 'avg_storage_gib', 'number': p / n / 1024, 'text': NULL}},
    {{'position': 9, 'metric': 'weighted_drr', 'number': p / r, 'text': NULL}}, {{'position': 10, 'metric': 'largest_vm', 'number': NULL, 'text': big.name}}, {{'position': 11, 'metric': 'total_avg_iops', 'number': a, 'text': NULL}},
    {{'position': 12, 'metric': 'hottest_vm', 'number': NULL, 'text': hot.name}}, {{'position': 13, 'metric': 'peak_throughput_mbs', 'number': 0.0, 'text': NULL}}, {{'position': 14, 'metric': 'iops_8k', 'number': 0.0, 'text': NULL}}]) AS s FROM g, big, hot)
    SELECT s.position AS position, s.metric AS metric, round(s.number::DOUBLE, 4) AS "number", s."text" AS "text" FROM x""")
def summary_rows(spark, sf_dir):
    """Values that are numbers as such, to four digits, and the others as texts."""
    number = F.round(F.expr("try_cast(value AS double)"), 4)
    return K.summary_rows(S.grand_summary(sized(spark, sf_dir))).select("position", "metric", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


@query(f"""WITH {o.SIZED} SELECT row_index, vm_name, os_name, workload_category, drr, provisioned_mib / 1024 AS provisioned_gib, in_use_mib / 1024 AS in_use_gib, round(required_mib / 1024, 4) AS required_gib FROM sized""")
def machine_detail(spark, sf_dir):
    return K.machine_detail(sized(spark, sf_dir)).withColumn("required_gib", F.round("required_gib", 4))


@query(f"""WITH {o.CLASSIFIED}, {_HIT} SELECT check_id, cluster, split_part(check_id, '.', 1) AS section, affected_count, round(affected_count * 100.0::DOUBLE / (SELECT count(*) FROM act), 1) AS pct FROM fnd""")
def findings_table(spark, sf_dir):
    return K.findings_table(H.run_health_checks(classified(spark, sf_dir))).select("check_id", "cluster", "section", "affected_count", "pct")
