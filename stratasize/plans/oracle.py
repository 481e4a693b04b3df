"""SQL that says the same as the operators, over the same tables, for an independent engine (DuckDB)."""

from __future__ import annotations

import re

from stratasize.functions.rules import FALLBACK_PRIORITY, Rule, default_rules, override_rules
from stratasize.functions.tables import iops_rows, ratio_rows
from stratasize.plans.fixtures import DESCRIPTIONS, FOLDERS, PREFIXES, SYSTEMS


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def name(k: str) -> str:
    return f"{_list(PREFIXES)}[({k}) % {len(PREFIXES)} + 1] || ({k})::VARCHAR"


#: The inventory as common table expressions.
INVENTORY = f"""
li AS (SELECT l_orderkey AS lk, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
ev AS (SELECT user_id AS ek, max(value) * 300 AS peak_iops, round(avg(value), 4) * 300 AS avg_iops FROM events GROUP BY 1),
inv AS (SELECT o_orderkey AS row_index, {name("o_orderkey")} AS vm_name,
    CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE {_list(SYSTEMS)}[o_orderkey % {len(SYSTEMS)} + 1] END AS os_name,
    (CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE 1 + o_orderkey % 16 END)::INTEGER AS num_cpus, ((o_orderkey % 32) * 1024)::DOUBLE AS memory_mib,
    coalesce(q, 0) * 8192 AS provisioned_mib, coalesce(q, 0) * 4096 AS in_use_mib, r_name AS datacenter,
    CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE n_name END AS cluster, o_orderkey % 41 = 0 AS is_template, o_orderstatus <> 'P' AS is_powered_on, (o_orderkey % 22)::INTEGER AS hw_version,
    CASE o_orderkey % 11 WHEN 0 THEN 'toolsNotInstalled' WHEN 1 THEN 'toolsNotRunning' WHEN 2 THEN 'toolsOld' ELSE 'toolsOk' END AS tools_status, peak_iops, avg_iops
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN li ON o_orderkey = lk LEFT JOIN ev ON o_orderkey = ek)"""


def _pattern(column: str, pattern: str) -> str:
    """A pattern as a predicate; lookaheads, which RE2 lacks, as several."""
    ahead = re.fullmatch(r"(?:\(\?=\.\*((?:[^()]|\((?:[^()])*\))*)\))+", pattern)
    parts = re.findall(r"\(\?=\.\*((?:[^()]|\((?:[^()])*\))*)\)", pattern) if ahead else [pattern.replace("(?![a-z])", "(?:[^a-z]|$)")]
    return "(" + " AND ".join(f"regexp_matches({column}, {text('(?i)' + p)})" for p in parts) + ")"


def rule_case(rules: list[Rule], what: str) -> str:
    """CASE over the rules' direct patterns, giving a field of the first that matches; null for none."""
    cases = []
    for r in rules:
        hits = [_pattern(c, p) for c, ps in (("role_name", r.names), ("os_name", r.systems), ("vm_folder", r.folders)) for p in ps]
        cases.append(f"WHEN {' OR '.join(hits)} THEN {text(getattr(r, what))}")
    return "CASE " + " ".join(cases) + " END"


#: The inventory through the cascade without similarity.
CLASSIFIED = f"""{INVENTORY},
ruled AS (SELECT *, {rule_case(override_rules(), "name")} AS rule FROM (SELECT *, regexp_replace(vm_name, '(?i)^(?:SRV|PC)[-_.]?', '') AS role_name, '' AS vm_folder FROM inv)),
packs(rule, c, s) AS (VALUES {", ".join(f"({text(r.name)}, {text(r.category)}, {text(r.subcategory)})" for r in override_rules() if r.priority < FALLBACK_PRIORITY)}),
cls AS (SELECT ruled.* EXCLUDE (rule, role_name, vm_folder), CASE WHEN c IS NOT NULL THEN c WHEN provisioned_mib >= 102400 THEN 'File' ELSE 'Unknown (Reducible)' END AS workload_category,
    CASE WHEN s IS NOT NULL THEN s WHEN provisioned_mib >= 102400 THEN 'General Purpose' ELSE 'Unknown (Reducible)' END AS workload_subcategory,
    CASE WHEN c IS NOT NULL THEN 'override:' || ruled.rule WHEN provisioned_mib >= 102400 THEN 'Large generic (>=100 GiB)' ELSE 'default' END AS classification_rule,
    CASE WHEN c IS NOT NULL THEN 'override' ELSE 'default' END AS classification_confidence FROM ruled LEFT JOIN packs USING (rule))"""

_BY_DESCRIPTION = " ".join(f"WHEN {' OR '.join(_pattern('vm_description', p) for p in r.names)} THEN {text(r.name)}" for r in override_rules() if r.description)
#: The inventory with folders and descriptions, and the first rule of an application by name, OS or folder, the first by
#: description, and the first that falls back.
DESCRIBED = f"""{INVENTORY},
des AS (SELECT * REPLACE (CASE WHEN row_index % 3 = 0 THEN 'node' || row_index::VARCHAR ELSE vm_name END AS vm_name), {_list(FOLDERS)}[row_index % {len(FOLDERS)} + 1] AS vm_folder,
    {_list(DESCRIPTIONS)}[row_index % {len(DESCRIPTIONS)} + 1] AS vm_description FROM inv),
said AS (SELECT row_index, provisioned_mib, {rule_case(override_rules(), "name")} AS direct, CASE {_BY_DESCRIPTION} END AS told, {rule_case([r for r in default_rules() if r.priority >= FALLBACK_PRIORITY], "name")} AS fallback
    FROM (SELECT *, regexp_replace(vm_name, '(?i)^(?:SRV|PC)[-_.]?', '') AS role_name FROM des))"""

RATIOS = "ratios(table_order, category, subcategory, ratio) AS (VALUES " + ", ".join(f"({i}, {text(c)}, {text(s)}, {r}::DOUBLE)" for i, c, s, r in ratio_rows()) + ")"
IOPS = "iops_table(workload_key, iops) AS (VALUES " + ", ".join(f"({text(k)}, {v}::DOUBLE)" for k, v in iops_rows()) + ")"

#: Classified machines with ratio and required space.
SIZED = f"""{CLASSIFIED}, {RATIOS},
sized AS (SELECT cls.* REPLACE (coalesce(peak_iops, 0) AS peak_iops, coalesce(avg_iops, 0) AS avg_iops), coalesce(ratio, 5.0)::DOUBLE AS drr, provisioned_mib / coalesce(ratio, 5.0)::DOUBLE AS required_mib,
    workload_category || '/' || workload_subcategory AS workload_key
    FROM cls LEFT JOIN ratios ON workload_category = category AND workload_subcategory = subcategory)"""
